"""Structure rules over a table of files (path, is_dir, depth, parent_path): each gives violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.globs import any_glob, glob_match
from sylva.functions.paths import STYLES, basename, depth, detect_style, first_match, leading_parents, parent, stem
from sylva.operators.predicates import violations

#: A test's path ends with one of these, or begins with it and is longer; it doesn't count against a directory's files.
TEST_PARTS = ("_test.go", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", "_spec.rb", "test_", "_test.py", "Test.java", "IT.java")
TEST_NAME = "(" + "|".join([p.replace(".", "[.]") + "$" for p in TEST_PARTS] + ["^" + p.replace(".", "[.]") + "." for p in TEST_PARTS]) + ")"


def files_from(table: DataFrame, path: Column) -> DataFrame:
    """Any table with a path-like column as a table of files."""
    return table.withColumn("path", path).withColumn("is_dir", F.lit(False)).withColumn("parent_path", parent(F.col("path"))).withColumn("depth", depth(F.col("path"), F.lit(False)))


def directories(files: DataFrame) -> DataFrame:
    """path, file_count, subdir_count of all directories that files imply; the root is left out."""
    parts = F.split(parent(F.col("path")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    dirs = files.select(F.explode(up).alias("path")).where("path != ''").distinct()
    counts = files.where("not is_dir").groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("file_count"))
    subs = dirs.groupBy(parent(F.col("path")).alias("path")).agg(F.count("*").alias("subdir_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return dirs.join(counts, "path", "left").join(subs, "path", "left").select("path", zero("file_count"), zero("subdir_count"))


def max_files(files: DataFrame, limit: int) -> DataFrame:
    n = files.where(~F.col("is_dir") & ~F.col("path").rlike(TEST_NAME)).groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return violations(n, "max-files-in-dir", F.format_string("contains %d files, exceeds limit of %d", "n", F.lit(limit)))


def max_subdirs(files: DataFrame, limit: int) -> DataFrame:
    d = directories(files).where(F.col("subdir_count") > limit)
    return violations(d, "max-subdirs", F.format_string("contains %d subdirectories, exceeds limit of %d", "subdir_count", F.lit(limit)))


def empty_directories(dirs: DataFrame) -> DataFrame:
    return violations(dirs.where("file_count = 0 and subdir_count = 0"), "empty-dirs", F.lit("directory is empty"))


def max_depth(files: DataFrame, limit: int, overrides: dict[str, int] | None = None) -> DataFrame:
    """The first override whose glob matches gives the limit."""
    own = F.coalesce(*[F.when(glob_match(F.col("path"), g), F.lit(n)) for g, n in (overrides or {}).items()], F.lit(limit))
    rows = files.withColumn("_limit", own).where("depth > _limit")
    return violations(rows, "max-depth", F.format_string("exceeds maximum depth of %d", "_limit"))


def case_conflicts(files: DataFrame) -> DataFrame:
    """All but the first of the paths that differ only in case within a directory."""
    w = Window.partitionBy("parent_path", F.lower(basename(F.col("path")))).orderBy("path")
    rows = files.select("path", "parent_path").distinct().withColumn("_first", F.first("path").over(w)).where(F.col("path") != F.col("_first"))
    return violations(rows, "case-conflicts", F.concat(F.lit("conflicts with "), "_first"))


def uniqueness(files: DataFrame, *keys: str, member: str) -> DataFrame:
    """Groups that should have one member and have more."""
    return files.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(member)), ",").alias("members")).where("n > 1")


def file_existence(dirs: DataFrame, files: DataFrame, requirements: dict[str, tuple[int, int]]) -> DataFrame:
    """dir, pattern, n for each directory and pattern whose count isn't within (least, most). Patterns are a few literals."""
    counted = files.groupBy(F.col("parent_path").alias("path")).agg(*[F.count_if(glob_match(F.col("path"), g, "match")).alias(f"c{i}") for i, g in enumerate(requirements)])
    rows = dirs.select("path").join(counted, "path", "left")
    checks = F.array(*[F.struct(F.lit(g).alias("pattern"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (g, (lo, hi)) in enumerate(requirements.items())])
    return rows.select("path", F.explode(checks).alias("r")).where("r.n < r.lo or r.n > r.hi").select("path", "r.pattern", "r.n")


def disallowed(files: DataFrame, patterns: list[str]) -> DataFrame:
    """A row for each file and pattern that it matches, unless a pattern after ! allows the file."""
    bad, allowed = [p for p in patterns if p[0] != "!"], [p[1:] for p in patterns if p[0] == "!"]
    hits = F.array_compact(F.array(*[F.when(glob_match(F.col("path"), p), F.lit(p)) for p in bad]))
    rows = files.where(~any_glob(F.col("path"), allowed)).select("path", F.explode(hits).alias("pattern"))
    return violations(rows, "disallowed-patterns", F.concat(F.lit("matches disallowed pattern "), "pattern"))


def naming(files: DataFrame, styles: dict[str, str]) -> DataFrame:
    """A row for each pattern that a file matches without having its style."""
    s = stem(F.col("path"))
    bad = F.array_compact(F.array(*[F.when(glob_match(F.col("path"), g) & ~STYLES[k](s), F.lit(k)) for g, k in styles.items()]))
    rows = files.select("path", F.explode(bad).alias("style"), detect_style(s).alias("found"))
    return violations(rows, "naming-convention", F.format_string("is %s, should be %s", "found", "style"))


def regex_match(files: DataFrame, glob: str, regex: str) -> DataFrame:
    """Names must match regex (not, after !), in which ${n} stands for segment n of the path."""
    negated, regex = regex.startswith("!"), regex.removeprefix("!")
    spec = F.lit(regex)
    for n in range(10):
        if f"${{{n}}}" in regex:
            spec = F.replace(spec, F.lit(f"${{{n}}}"), F.coalesce(F.get(F.split("path", "/"), F.lit(n)), F.lit("")))
    ok = F.regexp_like(basename(F.col("path")), spec)
    return violations(files.where(glob_match(F.col("path"), glob)).where(ok if negated else ~ok), "regex-match", F.lit(f"does not satisfy {regex}"))


def deep_relative_imports(imports: DataFrame, limit: int = 3) -> DataFrame:
    rows = imports.select(F.col("source_file").alias("path"), leading_parents(F.col("import_path")).alias("up")).where(F.col("up") >= limit)
    return violations(rows, "deep-relative-imports", F.format_string("goes up %d directories", "up"))


def symlinks(files: DataFrame) -> DataFrame:
    return violations(files.where("is_symlink"), "symlinks", F.lit("is a symbolic link"))


def missing_headings(docs: DataFrame, headings: list[str]) -> DataFrame:
    """path and the headings that its text lacks."""
    lacks = F.filter(F.array(*[F.lit(h) for h in headings]), lambda h: ~F.contains(F.col("text"), h))
    return docs.select("path", lacks.alias("missing")).where(F.size("missing") > 0)


def missing_tests(sources: DataFrame, tests: DataFrame, expected: Column) -> DataFrame:
    """Sources whose expected test isn't among tests (path)."""
    rows = sources.withColumn("_expected", expected).join(tests.select(F.col("path").alias("_expected")), "_expected", "left_anti")
    return violations(rows, "test-adjacency", F.lit("has no test"))


def misplaced_tests(tests: DataFrame, sources: DataFrame, keys: list[Column]) -> DataFrame:
    """Tests for which none of the alternative source keys exists."""
    tried = tests.withColumn("_key", F.explode(F.array(*keys)))
    good = tried.join(sources.select(F.col("path").alias("_key")), "_key", "left_semi").select("path").distinct()
    return violations(tests.join(good, "path", "left_anti"), "test-location", F.lit("has no source beside it"))


def layer_of(path: Column, layers: list[tuple[str, Column]]) -> Column:
    """The first layer whose condition holds."""
    return first_match([(cond, n) for n, cond in layers])
