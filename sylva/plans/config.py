"""Rule configuration: YAML files that cascade upward and extend one another, turned into one lazy plan of violations."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.globs import any_glob, gitignore_glob
from sylva.operators import documents as D, predicates as R, project as J, structure as S, workflows as W
from sylva.plans.external import SECONDS, external_rule
from sylva.sources import code


@dataclass
class Config:
    root: bool = False
    exclude: list[str] = field(default_factory=list)
    entrypoints: list[str] = field(default_factory=list)
    layers: list[dict] = field(default_factory=list)
    rules: dict = field(default_factory=dict)


def load(path: str, visited: tuple[str, ...] = ()) -> Config:
    """A file with what it extends (a path or several, relative to it) merged under it."""
    path = os.path.realpath(path)
    if path in visited:
        raise ValueError(f"configurations extend each other in a circle: {' -> '.join([*visited, path])}")
    with open(path) as f:
        raw = yaml.safe_load(f) or {}
    base = raw.pop("extends", [])
    parts = [load(os.path.join(os.path.dirname(path), b), (*visited, path)) for b in ([base] if isinstance(base, str) else base)]
    known = {k: v for k, v in raw.items() if k in Config.__dataclass_fields__ and v is not None}
    return merge([*parts, Config(**known)])


def merge(configs: list[Config]) -> Config:
    """Rules: the last wins; lists are appended."""
    out = Config()
    for c in configs:
        out.root |= c.root
        out.exclude += [x for x in c.exclude if x not in out.exclude]
        out.entrypoints += c.entrypoints
        out.layers += c.layers
        out.rules |= c.rules
    return out


def find(folder: str, name: str) -> Config:
    """All files of that name from folder upward, the nearest last, up to one that says root: true."""
    found, folder = [], os.path.realpath(folder)
    while True:
        if os.path.exists(p := os.path.join(folder, name)):
            found.insert(0, load(p))
            if found[0].root:
                break
        up = os.path.dirname(folder)
        if up == folder:
            break
        folder = up
    return merge(found)


def with_gitignore(config: Config, lines: list[str]) -> Config:
    return merge([config, Config(exclude=[g for x in lines if (g := gitignore_glob(x))])])


def _limit(spec, key: str) -> int:
    return int(spec[key] if isinstance(spec, dict) else spec)


def _contents(files: DataFrame) -> DataFrame | None:
    return files.where("not is_dir").select("path", "text") if "text" in files.columns else None


def _all_dirs(files: DataFrame) -> DataFrame:
    """Directories that files imply and those that are rows themselves, which may be empty."""
    implied = S.directories(files)
    rows = files.where("is_dir").select("path").distinct().join(implied.select("path"), "path", "left_anti")
    return implied.unionByName(rows.select("path", F.lit(0).cast("bigint").alias("file_count"), F.lit(0).cast("bigint").alias("subdir_count")))


def _deep_imports(files: DataFrame, spec) -> DataFrame:
    most = spec.get("max-parents", 3) if isinstance(spec, dict) else 3
    found = code.imports(_texts(files)).where("is_relative")
    return S.deep_relative_imports(found, most if most > 0 else 3).withColumn("rule", F.lit("disallow-deep-relative-imports"))


#: What a directive's comment begins with, before the colon.
MARKER = "@sylva"


def _texts(files: DataFrame) -> DataFrame:
    return files.where("not is_dir").select("path", "text")


def _directives(files: DataFrame) -> DataFrame | None:
    return code.directives(_texts(files), MARKER) if "text" in files.columns else None


#: Rules on the dependency graph, from it, the configuration and the rule's own; they need the files' `text`.
GRAPH_RULES = {
    "enforce-layer-boundaries": lambda project, config, spec: J.layer_boundaries(project, config.layers),
    "disallow-orphaned-files": lambda project, config, spec: J.orphaned_files(project, [*config.entrypoints, *((spec.get("entry-point-patterns") or []) if isinstance(spec, dict) else [])]),
    "disallow-import-cycles": lambda project, config, spec: J.import_cycles(project),
}

#: Rules by name, from files and what the configuration says; github-workflows, spec-adr and linter-config need the files' `text`.
RULES = {
    "max-depth": lambda files, spec: S.max_depth(files, _limit(spec, "max"), (spec.get("overrides") if isinstance(spec, dict) else None)),
    "max-files-in-dir": lambda files, spec: S.max_files(files, _limit(spec, "max")),
    "max-subdirs": lambda files, spec: S.max_subdirs(files, _limit(spec, "max")),
    "naming-convention": lambda files, spec: S.naming(files, spec),
    "disallowed-patterns": lambda files, spec: S.disallowed(files, spec),
    "regex-match": lambda files, spec: R.union_all([S.regex_match(files, g, r) for g, r in spec.items()]),
    "case-conflicts": lambda files, spec: S.case_conflicts(files),
    "symlinks": lambda files, spec: S.symlinks(files),
    "disallow-symlinks": lambda files, spec: S.symlinks(files).withColumn("rule", F.lit("disallow-symlinks")),
    "disallow-empty-dirs": lambda files, spec: S.empty_directories(_all_dirs(files)).withColumn("rule", F.lit("disallow-empty-dirs")),
    "disallow-deep-relative-imports": lambda files, spec: _deep_imports(files, spec),
    "uniqueness-constraints": lambda files, spec: J.uniqueness_constraints(files, spec),
    "path-based-layers": lambda files, spec: J.path_layers(files, spec["layers"]),
    "test-location": lambda files, spec: J.test_location(files, spec["file-patterns"], spec.get("integration-test-dir", ""), spec.get("allow-adjacent", True), spec.get("exemptions") or ()),
    "test-adjacency": lambda files, spec: J.test_adjacency(files, spec["file-patterns"], spec.get("test-dir") if spec.get("pattern") == "separate" else None, spec.get("exemptions") or (), _directives(files)),
    "ci-gates": lambda files, spec: W.required_workflows(files, "ci-gates", ("pr-gate", "merge-gate")),
    "fallow-gate": lambda files, spec: W.required_workflows(files, "fallow-gate", ("fallow",) if "sveltekit" in W.project_types(files, _contents(files)) else ()),
    "github-workflows": lambda files, spec: W.workflow_quality(files, files.where("not is_dir").select("path", "text"), spec if isinstance(spec, dict) else None),
    "spec-adr": lambda files, spec: D.specifications_and_decisions(files, spec if isinstance(spec, dict) else None),
    "spec-adr-enforcement": lambda files, spec: D.specifications_and_decisions(files, spec if isinstance(spec, dict) else None, "spec-adr-enforcement"),
    "linter-config": lambda files, spec: D.linter_settings(files),
    "file-existence": lambda files, spec: S.file_existence(S.directories(files), files, {g: count_range(n) for g, n in spec.items()}).select(F.lit("file-existence").alias("rule"), "path", F.format_string("has %d of %s", "n", "pattern").alias("message")),
}


def count_range(spec: str | int) -> tuple[int, int]:
    """"1", "0-2", "exists" and so on as least and most."""
    s = str(spec)
    if s in ("exists", "exists:1"):
        return 1, 1 << 30
    low, _, high = s.removeprefix("exists:").partition("-")
    if not low.isdigit() or (high and not high.isdigit()):
        raise ValueError(f"not a count: {spec!r}")
    return int(low), int(high or low)


def included(files: DataFrame, exclude: list[str]) -> DataFrame:
    """Files that neither match an exclusion nor lie in a directory that does (the reference's walker only leaves out directories)."""
    if not exclude:
        return files
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return files.where(~F.exists(up, lambda p: any_glob(p, exclude, "walker")))


def check(files: DataFrame, config: Config) -> DataFrame:
    """The violations of all rules that the configuration turns on (false turns one off); unknown rules are errors.

    Excluded paths are no part of the files that rules see. A rule of an outside program is one with a `command`. A rule
    whose own settings are wrong is a violation at "." and doesn't keep the others from their work.
    """
    files = included(files, config.exclude)
    on = {n: spec for n, spec in config.rules.items() if spec is not False}
    programs = {n: spec for n, spec in on.items() if n not in RULES and n not in GRAPH_RULES and isinstance(spec, dict) and spec.get("command")}
    unknown = set(config.rules) - set(RULES) - set(GRAPH_RULES) - set(programs)
    if unknown:
        raise ValueError(f"unknown rules: {', '.join(sorted(unknown))}")
    plans = {n: lambda n=n, spec=spec: RULES[n](files, spec) for n, spec in on.items() if n in RULES}
    if any(n in GRAPH_RULES for n in on):
        project = J.dependency_graph(files, _texts(files), config.layers)
        plans |= {n: lambda n=n, spec=spec: GRAPH_RULES[n](project, config, spec) for n, spec in on.items() if n in GRAPH_RULES}
    plans |= {n: lambda n=n, spec=spec: external_rule(files, n, spec["command"], spec.get("config"), float(spec.get("seconds", SECONDS))) for n, spec in programs.items()}
    parts = [planned(files, n, plan) for n, plan in plans.items()]
    if not parts:
        return R.violations(files.where(F.lit(False)), "none", F.lit(""))
    return not_ignored(R.union_all([p.select("rule", "path", "message") for p in parts]), files)


def planned(files: DataFrame, rule: str, plan: Callable[[], DataFrame]) -> DataFrame:
    """A rule's violations, or one row that says why its settings can't be read."""
    try:
        return plan()
    except (ValueError, TypeError, KeyError, AttributeError, AnalysisException) as e:
        said = f"{type(e).__name__}: {e}".split("\n")[0][:300]
        return files.sparkSession.createDataFrame([(rule, ".", f"rule failed: {said}")], "rule string, path string, message string")


def not_ignored(found: DataFrame, files: DataFrame) -> DataFrame:
    """Violations without those that their file's own directives switch off, whichever the rule; files without text have none."""
    if "text" not in files.columns:
        return found
    said = _directives(files)
    named = F.when(F.col("type") == "no-test", F.array(*map(F.lit, J.TEST_RULES))).when(F.size("rules") > 0, F.col("rules"))
    off = said.select("path", F.explode_outer(named).alias("_rule")).distinct()  # null: all rules
    return found.join(off.withColumnRenamed("path", "_path"), (F.col("path") == F.col("_path")) & (F.col("_rule").isNull() | (F.col("_rule") == F.col("rule"))), "left_anti")


def layer_column(config: Config, path: Column) -> Column:
    from sylva.functions.globs import layer_match

    return S.layer_of(path, [(x["name"], layer_match(path, x["path"])) for x in config.layers])
