"""CI workflows: YAML files as a table of steps, and rules over the steps.

Steps are parsed in Arrow batches where the files are; everything after that is aggregation. A file that isn't YAML, or has
no jobs, has no rows. A job without steps has one row with nulls, so that it is still a job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.paths import basename
from sylva.operators.predicates import union_all, violations

STEPS = "path string, job string, ord int, name string, run string, continue_on_error string, uses string"
#: The end of a command that hides its failure; words in the name of a step that checks quality.
MASKED = r"\|\|\s*(true|echo\s+['\"]?['\"]?)\s*$"
QUALITY_WORDS = ("lint", "typecheck", "type.check", "type check", "test", "pytest", "check", "quality", "coverage", "ruff", "pyright", "biome", "svelte-check")
#: Files that tell a project's type (by name), and the gates that its workflows must have (message: pattern).
PROJECT_FILES = {"sveltekit": ("svelte.config.js", "svelte.config.ts"), "python": ("pyproject.toml", "setup.py", "setup.cfg"), "go": ("go.mod",), "rust": ("Cargo.toml",)}
GATES = {
    "sveltekit": {
        "Missing required CI gate: svelte-check --fail-on-warnings": "svelte-check",
        "Missing required CI gate: biome check": "biome",
        "Missing required CI gate: vitest coverage": "(?s)(?=.*vitest)(?=.*coverage)",
        "Missing required CI gate: build": "(?s)(?=.*npm)(?=.*build)",
    },
    "python": {"Missing ruff check in CI": "ruff", "Missing pyright in CI": "pyright"},
    "go": {"Missing go test in CI": "go test|gotest", "Missing golangci-lint in CI": "(?s)(?=.*golangci)(?=.*lint)", "Missing go vet in CI": "go vet"},
    "rust": {
        "Missing cargo clippy in CI": "clippy",
        "Missing cargo fmt --check in CI": "cargo fmt|rustfmt",
        "Missing cargo test in CI": "(?s)^(?!.*test-lint).*cargo test",
        "Missing coverage gate in CI": "llvm-cov|tarpaulin|--fail-under",
    },
}
#: Gates that a configuration may add.
OPTIONAL_GATES = {
    "require-vitest-linter": ("sveltekit", "Missing required CI gate: vitest-linter", "vitest-linter"),
    "require-svelteuml": ("sveltekit", "Missing required CI gate: svelteuml", "svelteuml"),
    "require-pytest-linter": ("python", "Missing pytest-linter CI gate", "pytest-linter"),
    "require-cargo-test-lint": ("rust", "Missing cargo test-lint in CI", "test-lint"),
}
#: What a step that runs a tool must also say (project type, tool, whether the name counts, option, message).
OPTIONS = (
    ("python", "pytest", False, "--cov-branch", "pytest command missing --cov-branch"),
    ("python", "pytest", False, "--cov-fail-under", "pytest command missing --cov-fail-under"),
    ("sveltekit", "svelte-check", True, "--fail-on-warnings", "svelte-check without --fail-on-warnings"),
)


def is_workflow(path: Column) -> Column:
    return path.contains(".github/workflows/") & path.rlike(r"\.ya?ml$")


def workflow_steps(contents: DataFrame) -> DataFrame:
    """contents: path, text. One row a step; of jobs with one name in several files the last file's counts."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        columns = [c.split()[0] for c in STEPS.split(", ")]
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"]):
                try:
                    jobs = (yaml.load(text or "", yaml.BaseLoader) or {}).get("jobs")  # scalars stay as written
                except (yaml.YAMLError, AttributeError):
                    continue
                for job, body in jobs.items() if isinstance(jobs, dict) else ():
                    if not isinstance(body, dict):
                        continue
                    steps = [s for s in body["steps"] if isinstance(s, dict)] if isinstance(body.get("steps"), list) else []
                    scalar = lambda s, k: s[k] if isinstance(s.get(k), str) else ""
                    out += [(path, job, i, scalar(s, "name"), scalar(s, "run"), scalar(s, "continue-on-error"), scalar(s, "uses")) for i, s in enumerate(steps)] or [(path, job, None, None, None, None, None)]
            yield pd.DataFrame(out, columns=columns).astype({"ord": "Int32"})

    steps = contents.where(is_workflow(F.col("path"))).select("path", "text").mapInPandas(parse, STEPS)
    last = steps.groupBy("job").agg(F.max("path").alias("path"))
    return steps.join(last, ["job", "path"], "left_semi")


def _where() -> Column:
    return F.format_string('.github/workflows job="%s" step="%s"', "job", "name")


def command_masking(steps: DataFrame, rule: str = "github-workflows") -> DataFrame:
    rows = steps.where(F.col("run").rlike(MASKED)).withColumn("path", _where())
    return violations(rows, rule, F.format_string('Command masking on "%s": "%s"', "name", F.trim("run")))


def quality_may_fail(steps: DataFrame, rule: str = "github-workflows") -> DataFrame:
    """Steps that check quality and may fail without consequence."""
    checks = F.exists(F.array(*[F.lit(w) for w in QUALITY_WORDS]), lambda w: F.contains(F.lower("name"), w))
    rows = steps.where(F.col("continue_on_error").isin("true", "yes") & checks).withColumn("path", _where())
    return violations(rows, rule, F.format_string('continue-on-error on quality step "%s"', "name"))


def no_aggregator(steps: DataFrame, rule: str = "github-workflows") -> DataFrame:
    found = steps.agg(F.coalesce(F.bool_or(F.lower("job").rlike("required-checks|required\\.checks")), F.lit(False)).alias("ok"))
    return violations(found.where("not ok").withColumn("path", F.lit("")), rule, F.lit("Workflow missing a required-checks aggregator job"))


def missing_gates(steps: DataFrame, gates: dict[str, str], *by: str) -> DataFrame:
    """by, message: gates that no step of a group has; one aggregation however many gates there are."""
    text = F.lower(F.concat_ws(" ", "run", "name"))
    found = steps.groupBy(*by).agg(*[F.coalesce(F.bool_or(text.rlike(p)), F.lit(False)).alias(f"_g{i}") for i, p in enumerate(gates.values())])
    rows = F.array(*[F.struct(F.lit(m).alias("message"), F.col(f"_g{i}").alias("ok")) for i, m in enumerate(gates)])
    return found.select(*by, F.explode(rows).alias("_r")).where("not _r.ok").select(*by, "_r.message")


def missing_options(steps: DataFrame, kinds: list[str], rule: str = "github-workflows") -> DataFrame:
    parts = []
    for kind, tool, with_name, option, message in OPTIONS:
        text = F.lower(F.concat_ws(" ", "run", "name")) if with_name else F.lower("run")
        if kind in kinds:
            parts.append(violations(steps.where(text.contains(tool) & ~text.contains(option)).withColumn("path", F.lit("")), rule, F.lit(message)))
    return union_all(parts) if parts else violations(steps.where(F.lit(False)), rule, F.lit(""))


def project_types(files: DataFrame, contents: DataFrame | None = None) -> list[str]:
    """The types of project among the files: one aggregated row comes to the driver. contents (path, text) tells what package.json asks for."""
    flags = [F.bool_or(basename(F.col("path")).isin(*names)).alias(kind) for kind, names in PROJECT_FILES.items()]
    found = files.where("not is_dir").agg(*flags).first().asDict()
    if not found["sveltekit"] and contents is not None:
        found["sveltekit"] = bool(contents.where((basename(F.col("path")) == "package.json") & F.col("text").contains('"@sveltejs/kit"')).take(1))
    return [kind for kind in PROJECT_FILES if found[kind]]


def suppressions(contents: DataFrame, rule: str = "github-workflows") -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: x.contains("# noqa") | x.contains("# type: ignore"))
    rows = contents.where(F.col("path").endswith(".py") & (F.size(lines) > 0))
    return violations(rows, rule, F.lit("Python suppression comments exceed threshold"))


def workflow_quality(files: DataFrame, contents: DataFrame, spec: dict | None = None) -> DataFrame:
    """All workflow rules for the project types found; nothing where there is none."""
    spec = spec or {}
    kinds, steps = project_types(files, contents), workflow_steps(contents)
    asked = spec.get("global") or {}
    gates = {m: p for k in kinds for m, p in GATES[k].items()}
    gates |= {m: p for key, (k, m, p) in OPTIONAL_GATES.items() if k in kinds and (spec.get(k) or {}).get(key)}
    none = violations(files.where(F.lit(False)), "github-workflows", F.lit(""))
    if not kinds:
        return none
    parts = [none, missing_options(steps, kinds), missing_gates(steps, gates).select(F.lit("github-workflows").alias("rule"), F.lit("").alias("path"), "message")]
    parts += [f(steps) for key, f in (("disallow-command-masking", command_masking), ("disallow-continue-on-error-on-quality", quality_may_fail), ("require-required-checks-aggregator", no_aggregator)) if asked.get(key)]
    if "python" in kinds:
        parts.append(suppressions(contents))
    return union_all(parts)


def required_workflows(files: DataFrame, rule: str, names: tuple[str, ...]) -> DataFrame:
    """Workflows that must exist by the beginning of their name (pr-gate, merge-gate and the like)."""
    if not names:
        return violations(files.where(F.lit(False)), rule, F.lit(""))
    own = files.where(~F.col("is_dir") & F.col("path").rlike(r"^\.github/workflows/[^/]+\.ya?ml$"))
    found = own.agg(*[F.coalesce(F.bool_or(F.startswith(basename(F.col("path")), F.lit(n))), F.lit(False)).alias(f"_w{i}") for i, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_w{i}").alias("ok")) for i, n in enumerate(names)])
    missing = found.select(F.explode(rows).alias("_r")).where("not _r.ok").select("_r.name", F.format_string(".github/workflows/%s.yml", "_r.name").alias("path"))
    return violations(missing, rule, F.format_string("missing required CI workflow: %s.yml", "name"))
