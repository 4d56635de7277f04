"""Sections and headers by running scans; rules on specifications, decisions and linter settings."""

import tomllib

from pyspark.sql import functions as F

from sylva.operators import documents as D, structure as S
from sylva.plans import config as C
from sylva.sources.settings import front_matter, sections

SPEC = """# Feature Specification: X
## User Scenarios & Testing
### User Story 1 (Priority: P1)
## Requirements
### Functional Requirements
- **FR-001**: Done
## Success Criteria
- **SC-001**: Done
"""
DECISION = "---\nstatus: accepted\ndate: 2026-06-04\n---\n# One\n## Context and Problem Statement\n## Considered Options\n## Decision Outcome\n"
TYPES, RUFF = '[tool.pyright]\ntypeCheckingMode = "strict"\n', "[tool.ruff]\nline-length = 100\n"


def files(spark, texts):
    return S.files_from(spark.createDataFrame(list(texts.items()), "p string, text string"), F.col("p"))


def flat(tree, above=""):
    for k, v in tree.items():
        if isinstance(v, dict):
            yield from flat(v, f"{above}{k}.")
        else:
            yield f"{above}{k}", v


def test_sections_equal_a_parser(spark):
    text = """# first
title = "a # no comment" # one
plain.key = 'x'
"quoted key" = 3

[tool.black]   # why
line-length = 100
target = [
  "py3", # ]
  'x = [1',
]
long = \"\"\"
[not.a.section]
a = 1
\"\"\"
one = \"\"\"abc\"\"\"

[ tool . "ruff" ]
lint.select = ["E"]
empty = ""
inner = { a = "b, c", d = true }
[tool.x.y]
"""
    rows = sections(files(spark, {"a.toml": text, "crlf.toml": text.replace("\n", "\r\n"), "none.toml": None, "empty.toml": ""})).collect()
    want = dict(flat(tomllib.loads(text)))
    for path in ("a.toml", "crlf.toml"):
        mine = [r for r in rows if r.path == path]
        assert not [r for r in mine if r.kind == "error"]
        got = {".".join(x for x in (r.section, r.key) if x): r for r in mine if r.kind == "setting"}
        assert set(got) - {"tool.ruff.inner"} == set(want)
        for k in ("title", "plain.key", "tool.ruff.empty", "tool.ruff.inner.a"):
            assert got[k].quoted and got[k].value == want[k]
        assert (got["tool.black.line-length"].value, got["tool.ruff.inner.d"].value, got["quoted key"].quoted) == ("100", "true", False)
        assert {r.section for r in mine if r.kind == "section"} == {"tool.black", "tool.ruff", "tool.ruff.inner", "tool.x.y"}
    assert {r.path for r in rows} == {"a.toml", "crlf.toml"}
    wrong = sections(files(spark, {"w": "a = 1\nwhat is this\n[half\nb = 2"})).where("kind = 'error'").collect()
    assert [r.n for r in wrong] == [1, 2]


def test_front_matter(spark):
    texts = {
        "good": "\n  ---\r\nStatus: x\ndate:\n  deep: 1\n# note\n\"quoted key\": 1\nlist:\n- a: 1\n- b\nurl: http://x\nflow: [\n]\n---\nafter: 1",
        "none": "# Title\n---\na: 1\n---", "open": "---\na: 1\n", "long fence": "----\na: 1\n---", "empty": "---\n---", "blank": "", "null": None,
        "no map": "---\njust words\n---\n", "late": "x\n---\na: 1\n---", "time": "---\na:b: 1\n---", "bad": "---\na: 1\n%b\n---",
    }
    got = {r.path: r["keys"] for r in front_matter(files(spark, texts).select("path", "text")).collect()}
    assert sorted(got.pop("good")) == sorted(["Status", "date", "quoted key", "list", "url", "flow"])
    assert got.pop("empty") == [] and got.pop("time") == ["a:b"]
    assert got == dict.fromkeys(["none", "open", "long fence", "blank", "null", "no map", "late", "bad"])


def check(spark, texts, **spec):
    return {(r.path, r.message) for r in C.check(files(spark, texts), C.Config(rules={"spec-adr": spec or True})).collect()}


def test_folders(spark):
    assert check(spark, {"a/docs/specs/x.md": "", "docs/decisions/y.md": ""}) == set()
    both = check(spark, {"docs/specsx/a.md": "", "xdocs/adr/b.md": ""})
    assert both == {(".", D.NO_SPEC_FOLDER % "docs/specs, specifications"), (".", D.NO_DECISION_FOLDER % "docs/adr, docs/decisions")}
    assert check(spark, {"notes/a.md": ""}, **{"require-spec-folder": False, "adr-folder-paths": ["notes"]}) == set()


def test_specifications(spark):
    off = {"require-spec-folder": False, "require-adr-folder": False}
    texts = {
        "a/x-spec.md": SPEC, "FEATURE-one.MD": SPEC.replace("FR-", "F-"), "b/feature-two.md": SPEC.replace("SC-", "S-"), "feature-three.md": SPEC.replace("(Priority: P1)", ""),
        "feature-four.md": SPEC.replace("(Priority: P1)", "(Priority:P1)"), "other.md": "", "feature-none.md": None, "feature-five.md": "",
    }
    got = check(spark, texts, **off)
    said = [m for _, _, m in D.SPEC_FORMS]
    lacks = D.SPEC_LACKS % "\n  - ".join(D.SPEC_HEADINGS)
    assert got == {("feature-three.md", said[0]), ("FEATURE-one.MD", said[1]), ("b/feature-two.md", said[2]), ("feature-five.md", lacks)}
    own = check(spark, {"dir/subdir/spec-001.md": "# Other"}, **off, **{"spec-file-patterns": ["dir/**/spec-*.md"], "spec-required-headings": ["# Mine"]})
    assert own == {("dir/subdir/spec-001.md", D.SPEC_LACKS % "# Mine")}
    assert check(spark, texts, **off, **{"enforce-spec-template": False}) == set()


def test_decisions(spark):
    off = {"require-spec-folder": False, "require-adr-folder": False}
    texts = {
        "ADR-1.md": DECISION, "x/adr-2.md": DECISION.replace("status", "STATUS"), "ADR-3.md": DECISION.replace("status: accepted\n", "") + "status: accepted\n",
        "ADR-4.md": DECISION.replace("## Considered Options\n", ""), "ADR-5.md": DECISION.removeprefix("---\n"), "ADR-6.md": DECISION.replace("accepted\n", "accepted\n<!-- @sylva:ignore spec-adr -->\n"),
    }
    got = check(spark, texts, **off)
    assert got - {("ADR-6.md", D.NO_HEADER)} == {("ADR-3.md", "ADR must include a 'status' field."), ("ADR-4.md", D.DECISION_LACKS % "## Considered Options"), ("ADR-5.md", D.NO_HEADER)}
    owners = check(spark, {"ADR-1.md": DECISION}, **off, **{"adr-required-metadata": ["Owner:", "date"]})
    assert owners == {("ADR-1.md", "ADR must include a 'Owner' field.")}
    assert C.check(files(spark, {"ADR-1.md": ""}).limit(0), C.Config(rules={"spec-adr-enforcement": {**off}})).count() == 0


def linter(spark, **texts):
    return {(r.path, r.message) for r in C.check(files(spark, {k.replace("__", "."): v for k, v in texts.items()}), C.Config(rules={"linter-config": True})).collect()}


def test_linter_settings(spark):
    ok = {"__semgrep__yml": "rules: []\n"}
    no_types, no_ruff = "Python project missing [tool.pyright] configuration", "Python project missing [tool.ruff] configuration"
    assert linter(spark, README__md="") == {(".semgrep.yml", "missing required config file: .semgrep.yml")}
    py = lambda text: {m for _, m in linter(spark, pyproject__toml=text, **ok)}
    assert py(TYPES + RUFF) == set()
    assert py(RUFF) == {no_types} and py(TYPES) == {no_ruff} and py("") == {no_types, no_ruff}
    assert py(TYPES.replace("strict", "basic") + RUFF) == {'pyright typeCheckingMode should be "strict"'} == py("[tool.pyright]\n" + RUFF)
    assert py('[tool]\npyright = { typeCheckingMode = "strict" }\nruff.line-length = 3\n') == set()
    assert py('tool.pyright.typeCheckingMode = "strict"\n[tool.ruff.lint]\n') == set()
    assert py(TYPES + "what\n") == {"could not parse pyproject.toml: line 3"} and py(None) == {"could not read pyproject.toml"}
    assert py("[tool.pyright]\ntypeCheckingMode = 3\n") == {"could not parse pyproject.toml: line 2"}
    ts = lambda text: {m for _, m in linter(spark, tsconfig__json=text, **ok)}
    strict = "TypeScript project should have strict mode enabled"
    assert ts('{"compilerOptions": {"strict": true}}') == set()
    assert ts('{"compilerOptions": {"noImplicitAny": true}}') == {strict} == ts('{"compilerOptions": {"strict": false}}') == ts("{}")
    assert ts("{") == {"could not parse tsconfig.json"} == ts('{"compilerOptions": {"strict": "yes"}}') and ts(None) == {"could not read tsconfig.json"}


def test_linter_settings_of_projects(spark):
    table = files(spark, {"a/pyproject.toml": TYPES, "a/.semgrep.yml": "", "b/tsconfig.json": "{}", "b/deep/pyproject.toml": "", "pyproject.toml": ""})
    got = {(r.path, r.message) for r in D.linter_settings(table, spark.createDataFrame([("a",), ("b",), ("b",)], "root string")).collect()}
    assert got == {("a/pyproject.toml", "Python project missing [tool.ruff] configuration"), ("b/.semgrep.yml", "missing required config file: .semgrep.yml"), ("b/tsconfig.json", "TypeScript project should have strict mode enabled")}
