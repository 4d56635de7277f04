"""The dependency graph of a project's files as one plan, the rules on it, and rules on tests and path layers.

files: path, is_dir, parent_path; contents: path, text. Layers are a few dictionaries (name, path, dependsOn) in order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.globs import any_glob, glob_match, glob_regex, layer_match
from sylva.functions.paths import basename, extension, first_match, parent, resolve_import, stem, test_name
from sylva.operators import graph
from sylva.operators.predicates import violations
from sylva.operators.structure import misplaced_tests, missing_tests
from sylva.sources import code


class Project(NamedTuple):
    files: DataFrame  # path, layer (null: none), refs
    edges: DataFrame  # src, dst (relative ones from src's folder), written (as it is imported); one row an import


def dependency_graph(files: DataFrame, contents: DataFrame, layers: list[dict] = ()) -> Project:
    """Imports of all contents as edges; files with the first layer that takes them and the count of edges that refer to them."""
    own = files.where("not is_dir").select("path").distinct()
    found = code.imports(contents)
    target = F.when(F.col("is_relative"), resolve_import(F.col("source_file"), F.col("import_path"))).otherwise(F.col("import_path"))
    # written once, as all rules read it several times
    edges = graph.cut(found.select(F.col("source_file").alias("src"), target.alias("dst"), F.col("import_path").alias("written")))
    layer = first_match([(layer_match(F.col("path"), x["path"]), x["name"]) for x in layers])
    refs = graph.incoming_refs(edges, own)
    return Project(own.withColumn("layer", layer).join(refs, "path", "left").withColumn("refs", F.coalesce("refs", F.lit(0).cast("bigint"))), edges)


def layer_boundaries(project: Project, layers: list[dict]) -> DataFrame:
    """A row for each import from a layer into another that it may not depend on; unresolved imports and files without layer are free."""
    of = lambda c: project.files.where("layer is not null").select(F.col("path").alias(c), F.col("layer").alias(f"{c}_layer"))
    rows = graph.layer_targets(project.edges, project.files).join(of("src"), "src").join(of("target"), "target").where("src_layer != target_layer")
    free = F.lit(False)
    for x in layers:
        may = x.get("dependsOn") or []
        free = free | ((F.col("src_layer") == x["name"]) & (F.lit("*" in may) | F.col("target_layer").isin(*may)))
    message = F.format_string("layer '%s' cannot import from layer '%s' (imported: %s)", "src_layer", "target_layer", "target")
    return violations(rows.where(~free).withColumn("path", F.col("src")), "enforce-layer-boundaries", message)


def resolved_edges(project: Project, layer: str | None = None) -> DataFrame:
    """Different edges between files, as cycles see them (from imports as written); with a layer only those inside it."""
    rows = graph.cycle_targets(project.edges.select("src", F.col("written").alias("dst")), project.files).where("target is not null").select("src", F.col("target").alias("dst")).distinct()
    if layer is None:
        return rows
    inside = project.files.where(F.col("layer") == layer).select("path")
    return rows.join(inside.toDF("src"), "src", "left_semi").join(inside.toDF("dst"), "dst", "left_semi")


def cycles(project: Project, layer: str | None = None) -> DataFrame:
    """component (its smallest file), files, edges of each strongly connected part that has a cycle.

    Single cycles of a part depend on the order of visits and can be exponentially many; a part has them all.
    """
    edges = graph.cut(resolved_edges(project, layer))
    parts = graph.components(edges)
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"k{c}"))
    n = edges.join(of("src"), "src").join(of("dst"), "dst").where("ksrc = kdst").groupBy(F.col("ksrc").alias("component")).agg(F.count("*").alias("edges"))
    return parts.groupBy("component").agg(F.count("*").alias("files")).join(n, "component").select("component", "files", "edges")


def import_cycles(project: Project, layer: str | None = None) -> DataFrame:
    """A row for each part that has a cycle, at its smallest file."""
    return violations(cycles(project, layer).withColumn("path", F.col("component")), "disallow-import-cycles", F.lit("cyclic dependency detected"))


#: What the reports of cycles advise.
CYCLE_ADVICE = ("Break the cycle with an interface or abstraction", "Apply dependency inversion to invert the import direction")


def cycle_reports(project: Project, layer: str | None = None) -> DataFrame:
    """rule, path, message, context, suggestions, files: a shortest cycle of each part that has one.

    The cycle begins at the part's smallest file; path is the file whose import closes it.
    """
    found = graph.witness_cycles(resolved_edges(project, layer))
    rows = found.withColumn("path", F.element_at("cycle", -1))
    context = F.concat(F.lit("cycle: "), F.array_join(F.concat("cycle", F.slice("cycle", 1, 1)), " -> "))
    return rows.select(F.lit("disallow-import-cycles").alias("rule"), "path", F.lit("cyclic dependency detected").alias("message"), context.alias("context"), F.array(*map(F.lit, CYCLE_ADVICE)).alias("suggestions"), F.col("length").alias("files"))


#: Extensions whose imports are read; names that begin a program; parts of tests' paths; names of settings.
PARSED = (".go", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", ".java", ".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".cs")
ENTRY_NAMES = ("main.go", "main.ts", "main.js", "main.py", "index.ts", "index.js", "app.ts", "app.js", "app.py", "__init__.py", "manage.py")
ENTRY_PARTS = ("_test.", ".test.", ".spec.")
SETTINGS = ("package.json", "tsconfig.json", "go.mod", "go.sum", "setup.py", "pyproject.toml", "Makefile", ".gitignore", ".eslintrc", ".prettierrc")


def entry_match(path: Column, pattern: str) -> Column:
    """Whether a path is an entry point: around a single ** a beginning and the name's glob, else the path or its name's glob."""
    named = lambda glob: basename(path).rlike(glob_regex(glob, "match") or "a^")
    if pattern.count("**") == 1:
        head, tail = pattern.split("**")
        tail = tail.removeprefix("/")
        return path.startswith(head.removesuffix("/")) & (named(tail) if tail else F.lit(True))
    return (path == pattern) | named(pattern)


def orphaned_files(project: Project, entrypoints: list[str] = ()) -> DataFrame:
    """Files of languages whose imports are read, that nothing refers to and that are no entry points, tests or settings."""
    path, name = F.col("path"), basename(F.col("path"))
    free = name.isin(*ENTRY_NAMES)
    for p in entrypoints:
        free = free | entry_match(path, p)
    for p in ENTRY_PARTS:
        free = free | F.contains(path, F.lit(p))
    for p in SETTINGS:
        free = free | name.startswith(p)
    rows = project.files.where(extension(path).isin(*PARSED) & ~free & (F.col("refs") == 0))
    return violations(rows, "disallow-orphaned-files", F.lit("file is orphaned (not imported by any other file)"))


#: Rules that a no-test directive switches off.
TEST_RULES = ("test-adjacency", "test-location")


def not_ignored(files: DataFrame, directives: DataFrame, rule: str) -> DataFrame:
    """Files without a directive against the rule; one that names no rule is against all, no-test against rules on tests."""
    against = F.when(F.col("type") == "ignore", (F.size("rules") == 0) | F.array_contains("rules", rule)).otherwise(F.lit(rule in TEST_RULES))
    hit = directives.where(against).select("path").distinct()
    return files.join(hit, "path", "left_anti")


def segment(pattern: str) -> str | None:
    """The last named folder of a layer's pattern that has two or more, between slashes."""
    parts = pattern.replace("*", "").strip("/").split("/")
    return f"/{parts[-1]}/" if len(parts) > 1 else None


def path_layers(files: DataFrame, layers: list[dict]) -> DataFrame:
    """Files whose path holds what their layer forbids, or a folder of a layer that it can't depend on.

    layers: name, patterns, canDependOn, forbiddenPaths. A file is in the first layer that takes it. A folder that is part
    of a forbidden path which the file was already found by isn't reported again; no canDependOn allows everything.
    """
    path, rule = F.col("path"), "path-based-layers"
    by_name: dict[str, dict] = {}
    for x in layers:
        by_name.setdefault(x["name"], x)
    own = F.lit(None).cast("array<string>")
    for x in reversed(layers):
        name, may = x["name"], x.get("canDependOn") or []
        hits = [(p, glob_match(path, p, "layer")) for p in x.get("forbiddenPaths") or []]
        found = [F.when(hit, F.lit(f"layer '{name}' file contains forbidden path pattern '{p}'")) for p, hit in hits]
        others = [y for n, y in by_name.items() if n != name and n not in may] if may else []
        for other in others:
            for s in filter(None, map(segment, other.get("patterns") or [])):
                known = F.lit(False)
                for p, hit in hits:
                    known = known | hit if s.strip("/") in p else known
                text = f"layer '{name}' file contains path from layer '{other['name']}' which is not in its allowed dependencies (canDependOn: [{' '.join(may)}])"
                found.append(F.when(F.contains(path, F.lit(s)) & ~known, F.lit(text)))
        messages = F.array_compact(F.array(*found)) if found else F.expr("cast(array() as array<string>)")
        own = F.when(any_glob(path, x.get("patterns") or [], "layer"), messages).otherwise(own)
    rows = files.where("not is_dir").select("path", F.explode(own).alias("message"))
    return violations(rows, rule, F.col("message"))


def uniqueness_constraints(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Directories in which several names match a pattern that is `singleton` or `unique`; after a leading * an end counts as well."""
    name = basename(F.col("path"))
    hits = []
    for p, kind in patterns.items():
        if kind in ("singleton", "unique"):
            match = name.rlike(glob_regex(p, "match") or "a^")
            hits.append(F.when(match | name.endswith(p[1:]) if p.startswith("*") else match, F.lit(p)))
    kinds = F.array_compact(F.array(*hits)) if hits else F.expr("cast(array() as array<string>)")
    rows = files.where("not is_dir").select("path", F.coalesce(F.nullif("parent_path", F.lit("")), F.lit(".")).alias("dir"), F.explode(kinds).alias("pattern"))
    several = rows.groupBy("dir", "pattern").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("all")).where("n > 1")
    return violations(several.withColumn("path", F.col("dir")), "uniqueness-constraints", F.format_string("multiple files match pattern '%s' (singleton constraint violated): %s", "pattern", "all"))


#: What makes a name a test's; the last only where tests' places are checked. And what a source's name lacks, in order.
TEST_MARKS = ("_test", ".test", ".spec", "_spec", "Test", "test_")
TEST_AFFIXES = ("_test", "_pbt", "_bench", "_fuzz", ".test", ".spec", "_spec", "Test", "test_")


def source_name(name: Column) -> Column:
    """A test's name without extension and affixes: the first affix that it has is taken out everywhere, until it has none."""
    take = lambda s: F.coalesce(*[F.when(F.contains(s, F.lit(a)), F.replace(s, F.lit(a), F.lit(""))) for a in TEST_AFFIXES], s)
    bare = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.aggregate(F.sequence(F.lit(0), F.length(bare)), bare, lambda s, _: take(s))


def _has(name: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(name, F.lit(m))
    return out


def _beside(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def test_location(files: DataFrame, patterns: list[str], integration: str = "", adjacent: bool = True, exempt: list[str] = ()) -> DataFrame:
    """Tests that are neither beside their source, whatever its extension, nor in the folder of integration tests."""
    path, folder = F.col("path"), parent(F.col("path"))
    own = files.where("not is_dir").withColumn("_test", _has(basename(path), TEST_MARKS))
    keys = own.where("not _test").select(F.explode(F.array(path, _beside(folder, stem(path)))).alias("path"))
    asked = own.where("_test").where(any_glob(path, patterns) & ~any_glob(path, list(exempt)))
    if integration:
        asked = asked.where(~path.startswith(f"{integration}/"))
    source = source_name(basename(path))
    tries = [_beside(folder, source), _beside(folder, F.concat(source, extension(path)))] if adjacent else [F.lit(None).cast("string")]
    tries = [F.when(source != "", t) for t in tries]
    message = "test file not adjacent to source code" + (f" and not in integration test directory '{integration}/'" if integration else "")
    return misplaced_tests(asked.select("path"), keys, tries).withColumn("message", F.lit(message))


def test_adjacency(files: DataFrame, patterns: list[str], folder: str | None = None, exempt: list[str] = (), directives: DataFrame | None = None) -> DataFrame:
    """Sources without a test beside them or, with a folder, at the same place under it; directives may free a source."""
    path = F.col("path")
    own = files.where("not is_dir").where(any_glob(path, patterns))
    under = path.startswith(f"{folder}/") if folder else F.lit(False)
    sources = own.where(~under & ~_has(stem(path), TEST_MARKS[:-1]) & ~any_glob(path, list(exempt)))
    if directives is not None:
        sources = not_ignored(sources, directives, "test-adjacency")
    expected = _beside(parent(path), test_name(path))
    expected = F.concat(F.lit(f"{folder}/"), expected) if folder else expected
    tests = files.where("not is_dir").where(under) if folder else files.where("not is_dir")
    return missing_tests(sources.select("path"), tests.select("path").distinct(), expected)
