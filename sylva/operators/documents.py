"""Rules over documents and settings: specifications, decisions, settings of linters.

files: path, is_dir, parent_path, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.globs import suffix_match
from sylva.operators.predicates import union_all, violations
from sylva.operators.structure import directories
from sylva.sources.settings import header_keys, sections

#: Folders, names, headings and keys that are looked for where a configuration names none, and the messages.
SPEC_FOLDERS, DECISION_FOLDERS = ("docs/specs", "specifications"), ("docs/adr", "docs/decisions")
SPEC_FILES, DECISION_FILES = ("*-spec.md", "feature-*.md"), ("ADR-*.md", "adr-*.md")
SPEC_HEADINGS = ("# Feature Specification:", "## User Scenarios & Testing", "## Requirements", "### Functional Requirements", "## Success Criteria")
DECISION_HEADINGS = ("## Context and Problem Statement", "## Considered Options", "## Decision Outcome")
DECISION_KEYS = ("status:", "date:")
NO_SPEC_FOLDER = "No specification folder found. Expected one of: %s. Create a dedicated folder for feature specifications to maintain clear documentation structure."
NO_DECISION_FOLDER = "No ADR (Architecture Decision Record) folder found. Expected one of: %s. Create a dedicated folder for ADRs to document architectural decisions."
SPEC_LACKS = """Feature specification is missing required sections:
  - %s

Each feature spec must include:
  1. User Scenarios & Testing (with prioritized, independently testable user stories)
  2. Functional Requirements (FR-### format)
  3. Success Criteria (SC-### format with measurable outcomes)"""
DECISION_LACKS = """ADR is missing required sections:
  - %s

Each ADR must include:
  1. Context and Problem Statement
  2. Considered Options
  3. Decision Outcome (with chosen option and justification)"""
#: A heading, what must be in a text that has it, the message if not.
SPEC_FORMS = (
    ("## User Scenarios & Testing", ("(Priority: P", "(Priority:P"), "Feature specification must include prioritized user stories (e.g., 'Priority: P1', 'Priority: P2'). Each story should be independently testable."),
    ("### Functional Requirements", ("FR-",), "Functional requirements must use FR-### format (e.g., 'FR-001: System MUST...')."),
    ("## Success Criteria", ("SC-",), "Success criteria must use SC-### format (e.g., 'SC-001: Users can...')."),
)
NO_HEADER = "ADR must include valid YAML frontmatter (between '---' delimiters) containing required metadata fields."
RULES_FILE = ".semgrep.yml"


def _has(text: str) -> Column:
    return F.contains(F.col("text"), F.lit(text))


def _lacking(headings, form: str) -> Column:
    """The message that names the headings a text lacks, else null."""
    lacks = F.array_compact(F.array(*[F.when(~_has(h), F.lit(h)) for h in headings]))
    before, after = form.split("%s")
    return F.when(F.size(lacks) > 0, F.concat(F.lit(before), F.array_join(lacks, "\n  - "), F.lit(after)))


def _named(files: DataFrame, patterns) -> DataFrame:
    """Files with a text whose path, or an end of it, matches one of the patterns."""
    ok = F.lit(False)
    for p in patterns:
        ok = ok | suffix_match(F.col("path"), p)
    return files.where(~F.col("is_dir") & F.col("text").isNotNull() & ok)


def folder_missing(files: DataFrame, folders, rule: str, form: str) -> DataFrame:
    """One violation at "." if no directory is one of folders or ends with one."""
    dirs = directories(files).select("path").union(files.where("is_dir").select("path"))
    there = F.lit(False)
    for f in folders:
        there = there | (F.col("path") == f) | F.endswith(F.col("path"), F.lit(f"/{f}"))
    none = dirs.agg(F.coalesce(F.bool_or(there), F.lit(False)).alias("_there")).where("not _there").withColumn("path", F.lit("."))
    return violations(none, rule, F.lit(form % ", ".join(folders)))


def specification_rule(files: DataFrame, rule: str, headings, patterns) -> DataFrame:
    """A violation for the headings that a specification lacks, and one for each heading whose form its text doesn't have anywhere."""
    forms = [F.when(_has(h) & ~F.greatest(*[_has(x) for x in marks], F.lit(False)), F.lit(said)) for h, marks, said in SPEC_FORMS]
    said = F.array_compact(F.array(_lacking(headings, SPEC_LACKS), *forms))
    return violations(_named(files, patterns).select("path", F.explode(said).alias("_said")), rule, F.col("_said"))


def decision_rule(files: DataFrame, rule: str, headings, keys, patterns) -> DataFrame:
    """A violation for the headings that a decision lacks, and one for each key that its header lacks (or one if it has no right header); case doesn't count."""
    own = _named(files, patterns).select("path", "text", header_keys(F.col("text")).alias("keys"))
    has = F.transform("keys", F.lower)
    plain = [k.removesuffix(":") for k in keys]
    lacks = F.array_compact(F.array(*[F.when(~F.array_contains(has, k.lower()), F.lit(f"ADR must include a '{k}' field.")) for k in plain]))
    said = F.concat(F.array_compact(F.array(_lacking(headings, DECISION_LACKS))), F.when(F.col("keys").isNull(), F.array(F.lit(NO_HEADER))).otherwise(lacks))
    return violations(own.select("path", F.explode(said).alias("_said")), rule, F.col("_said"))


def specifications_and_decisions(files: DataFrame, spec: dict | None = None, rule: str = "spec-adr") -> DataFrame:
    """All four checks; each is on unless spec turns it off, an empty list stands for the usual one. Documents without text aren't looked at."""
    said = spec or {}
    on = lambda key: said.get(key) is not False
    listed = lambda key, usual: tuple(said.get(key) or usual)
    parts = [violations(files.where(F.lit(False)), rule, F.lit(""))]
    if on("require-spec-folder"):
        parts.append(folder_missing(files, listed("spec-folder-paths", SPEC_FOLDERS), rule, NO_SPEC_FOLDER))
    if on("require-adr-folder"):
        parts.append(folder_missing(files, listed("adr-folder-paths", DECISION_FOLDERS), rule, NO_DECISION_FOLDER))
    if on("enforce-spec-template"):
        parts.append(specification_rule(files, rule, listed("spec-required-headings", SPEC_HEADINGS), listed("spec-file-patterns", SPEC_FILES)))
    if on("enforce-adr-template"):
        parts.append(decision_rule(files, rule, listed("adr-required-headings", DECISION_HEADINGS), listed("adr-required-metadata", DECISION_KEYS), listed("adr-file-patterns", DECISION_FILES)))
    return union_all(parts)


def linter_settings(files: DataFrame, roots: DataFrame | None = None, rule: str = "linter-config") -> DataFrame:
    """Violations of the settings at each project's root (roots: root; by default the tree's own, ""): no rules file, no strict types, no linter.

    A settings file that can't be read or parsed is one violation and isn't looked at further. Files count only beside the root itself.
    """
    roots = roots.select("root").distinct() if roots is not None else files.sparkSession.createDataFrame([("",)], "root string")
    top = files.where("not is_dir").join(roots, F.col("parent_path") == F.col("root"), "left_semi").withColumn("_name", F.substring_index("path", "/", -1))
    has = top.where(F.col("_name") == RULES_FILE).select(F.col("parent_path").alias("root")).distinct()
    at = F.concat_ws("/", F.when(F.col("root") != "", F.col("root")), F.lit(RULES_FILE))
    absent = violations(roots.join(has, "root", "left_anti").withColumn("path", at), rule, F.lit(f"missing required config file: {RULES_FILE}"))

    python = top.where("_name = 'pyproject.toml'").select("path", "text")
    full = F.concat_ws(".", F.when(F.col("section") != "", F.col("section")), F.when(F.col("kind") == "setting", F.col("key")))
    under = lambda name: F.coalesce(F.bool_or((full == name) | F.startswith(full, F.lit(f"{name}."))), F.lit(False))
    mode = full == "tool.pyright.typeCheckingMode"
    facts = sections(python).groupBy(F.col("path").alias("_path")).agg(
        F.min(F.when((F.col("kind") == "error") | (mode & ~F.col("quoted")), F.col("n"))).alias("_wrong"),
        under("tool.pyright").alias("_types"), under("tool.ruff").alias("_ruff"), F.max(F.when(mode, F.col("value"))).alias("_mode"),
    )
    python = python.join(facts, F.col("path") == F.col("_path"), "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    types = F.when(~yes("_types"), "Python project missing [tool.pyright] configuration").when(~F.coalesce(F.col("_mode") == "strict", F.lit(False)), 'pyright typeCheckingMode should be "strict"')
    said = F.array(types, F.when(~yes("_ruff"), "Python project missing [tool.ruff] configuration"))
    said = F.when(F.col("text").isNull(), F.array(F.lit("could not read pyproject.toml"))).when(F.col("_wrong").isNotNull(), F.array(F.format_string("could not parse pyproject.toml: line %d", F.col("_wrong") + 1))).otherwise(said)

    script = top.where("_name = 'tsconfig.json'").select("path", "text")
    strict = F.get_json_object("text", "$.compilerOptions.strict")
    broken = F.try_parse_json("text").isNull() | ~F.coalesce(strict, F.lit("false")).isin("true", "false")
    told = F.when(F.col("text").isNull(), "could not read tsconfig.json").when(broken, "could not parse tsconfig.json")
    told = told.when(F.coalesce(strict, F.lit("false")) == "false", "TypeScript project should have strict mode enabled")
    both = python.select("path", F.array_compact(said).alias("_all")).union(script.select("path", F.array_compact(F.array(told))))
    return union_all([absent, violations(both.select("path", F.explode("_all").alias("_said")), rule, F.col("_said"))])
