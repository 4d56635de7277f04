"""Workflows, profile, fixes, scaffolds and reports."""

import json

import pytest
from pyspark.sql import functions as F

from sylva.operators import fixes as X, graph, profile, sinks, structure as S, workflows as W
from sylva.plans import config as C

CI = """
on: push
jobs:
  build:
    steps:
      - name: Unit test
        run: go test ./... || true
        continue-on-error: yes
      - uses: actions/checkout@v4
      - name: Vet
        run: go vet ./...
  empty: {}
  odd: [1]
"""


def contents(spark, **more):
    rows = {".github/workflows/ci.yml": CI, ".github/workflows/bad.yml": "a: [", ".github/workflows/none.yaml": None, ".github/workflows/pr-gate.yml": "jobs: 3", "go.mod": "module x", "docs/a.yml": CI} | more
    return S.files_from(spark.createDataFrame(list(rows.items()), "p string, text string"), F.col("p"))


def test_workflow_steps(spark):
    got = W.workflow_steps(contents(spark)).orderBy("job", "ord").collect()
    assert [(r["job"], r["ord"], r["name"], r["continue_on_error"], r["uses"]) for r in got] == [("build", 0, "Unit test", "yes", ""), ("build", 1, "", "", "actions/checkout@v4"), ("build", 2, "Vet", "", ""), ("empty", None, None, None, None)]


def test_workflow_rules(spark):
    on = {"global": {"disallow-command-masking": True, "disallow-continue-on-error-on-quality": True, "require-required-checks-aggregator": True}}
    got = {r["message"] for r in C.check(contents(spark), C.Config(rules={"github-workflows": on, "ci-gates": True, "fallow-gate": True})).collect()}
    assert got == {'Command masking on "Unit test": "go test ./... || true"', 'continue-on-error on quality step "Unit test"', "Workflow missing a required-checks aggregator job", "Missing golangci-lint in CI", "missing required CI workflow: merge-gate.yml"}
    nothing = contents(spark).where("path = 'docs/a.yml'")
    assert C.check(nothing, C.Config(rules={"github-workflows": on})).count() == 0


def test_python_and_svelte_workflows(spark):
    ci = "jobs:\n  required-checks:\n    steps:\n      - run: pytest --cov-branch && ruff . && svelte-check\n"
    table = contents(spark, **{".github/workflows/ci.yml": ci, "go.mod2": "", "setup.cfg": "", "package.json": '{"devDependencies": {"@sveltejs/kit": "2"}}', "x.py": "a  # noqa\n"}).where("path != 'go.mod'")
    assert W.project_types(table, table.select("path", "text")) == ["sveltekit", "python"]
    got = {(r["path"], r["message"]) for r in W.workflow_quality(table, table.select("path", "text"), {"python": {"require-pytest-linter": True}}).collect()}
    assert got == {("", m) for m in ("pytest command missing --cov-fail-under", "svelte-check without --fail-on-warnings", "Missing pyright in CI", "Missing pytest-linter CI gate", "Missing required CI gate: biome check", "Missing required CI gate: vitest coverage", "Missing required CI gate: build")} | {("x.py", "Python suppression comments exceed threshold")}


def test_profile(spark):
    files = S.files_from(spark.createDataFrame([(f"a/b/f{i}.py",) for i in range(30)] + [("README.md",), ("a/b/readme.rst",)], "p string"), F.col("p"))
    assert tuple(profile.recommended_limits(files).first()) == (4, 37, 10)
    assert tuple(profile.recommended_limits(files.limit(0)).first()) == (4, 20, 10)
    assert tuple(profile.documentation(files).first()) == (2, 2, True)
    assert "max: 37" in profile.generated_config(files)


def test_fixes_are_taken_back(tmp_path):
    (tmp_path / "a.py").write_text("import old\n")
    move, change = X.Action("move", "a.py", target="lib/a.py"), X.Action("replace", "lib/a.py", old="old", text="new")
    bad = X.apply_fixes(tmp_path, [([move, change, X.Action("replace", "lib/a.py", old="absent")], True)])
    assert (bad.applied, bad.failed) == (0, 1) and (tmp_path / "a.py").read_text() == "import old\n" and not (tmp_path / "lib/a.py").exists()
    assert X.apply_fixes(tmp_path, [([move], True)], dry_run=True).skipped == 1 and X.apply_fixes(tmp_path, [([move], False)]).skipped == 1
    assert X.apply_fixes(tmp_path, [([move, change], False)], unsafe=True).applied == 1 and (tmp_path / "lib/a.py").read_text() == "import new\n"


def test_scaffold_refuses_to_overwrite(tmp_path):
    made = X.scaffold(tmp_path, {"${name}.py": "class $title: ...\n"}, name="user", title="User")
    assert open(made[0]).read() == "class User: ...\n"
    with pytest.raises(FileExistsError):
        X.scaffold(tmp_path, {"other.py": "", "${name}.py": ""}, name="user")
    assert not (tmp_path / "other.py").exists()


def test_possible_importers(spark):
    files = S.files_from(spark.createDataFrame([(p,) for p in ("a/b/x.py", "a/y.py", "a/b/c/z.py", "q/w.py", "a/bb/v.py")], "p string"), F.col("p"))
    got = {r["path"] for r in X.possible_importers(spark.createDataFrame([("a/b/x.py",)], "source string"), files).collect()}
    assert got == {"a/y.py", "a/b/c/z.py"}


def test_reports(spark):
    v = spark.createDataFrame([("r", "p", "m", "e", None, ["s", "t"])], "rule string, path string, message string, expected string, actual string, suggestions array<string>")
    assert sinks.detailed_lines(v).first()["line"] == "p: m\n  Expected: e\n  Suggestions:\n    - s\n    - t"
    pairs = spark.createDataFrame([("x", "y", 1, 2, 20), ("x", "x", 0, 50, 30)], "a string, b string, start_a int, start_b int, tokens int")
    assert tuple(sinks.clone_summary(pairs).first()) == (2, 50, 1) and [r["line"] for r in sinks.clone_lines(pairs).collect()] == ["x:0 = x:50 (30 tokens)", "x:1 = y:2 (20 tokens)"]
    report = json.loads(sinks.clone_sarif(pairs).first()["json"])
    assert report["version"] == "2.1.0" and len(report["runs"][0]["results"]) == 2
    assert json.loads(sinks.clone_sarif(pairs.limit(0)).first()["json"])["runs"][0]["results"] == []


def test_mermaid(spark):
    nodes = spark.createDataFrame([("a/b/c.py", "domain"), ("d.py", None), ("e.py", "other")], "path string, layer string")
    edges = spark.createDataFrame([("a/b/c.py", "d.py", True, True), ("d.py", "e.py", False, True), ("d.py", "gone.py", False, False)], "src string, dst string, cycle boolean, violation boolean")
    lines = [r["line"] for r in graph.mermaid_lines(nodes, edges).collect()]
    assert lines[0] == "graph LR" and "-.->|cycle|" in lines[1] and '["b/c.py"]' in lines[1] and "-.->|violation|" in lines[2] and "-->" not in lines[3] and lines[4].startswith("  style n") and len(lines) == 5
    assert graph.mermaid_document(graph.mermaid_lines(nodes, edges)).startswith("```mermaid\ngraph LR\n") and "<h1>A &amp; B</h1>" in graph.mermaid_document(graph.mermaid_lines(nodes, edges), "html", "A & B")
