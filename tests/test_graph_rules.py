"""The dependency graph and its rules, tests' places, path layers and directives."""

import pytest
from pyspark.sql import functions as F

from sylva.operators import project as J, structure as S
from sylva.plans import config as C
from sylva.sources import code

LAYERS = [{"name": "domain", "path": "src/domain/**", "dependsOn": []}, {"name": "app", "path": "src/app/**", "dependsOn": ["domain"]}, {"name": "ui", "path": "src/ui/**", "dependsOn": ["*"]}]
TEXTS = {
    "src/domain/user.ts": "import { s } from '../app/service'",
    "src/app/service.ts": "import { u } from '../domain/user'\nimport React from 'react'",
    "src/ui/view.ts": "import { s } from '../app/service'\nimport { u } from '../domain/user'",
    "src/ui/parts/index.ts": "import x from '../view'",
    "src/lone.py": "",
    "src/lone_test.py": "import lone",
    "setup.py": "",
    "notes.rs": "use a;",
}


def files(spark, texts):
    rows = texts.items() if isinstance(texts, dict) else [(p, None) for p in texts]
    return S.files_from(spark.createDataFrame(list(rows), "p string, text string"), F.col("p"))


def test_graph_and_its_rules(spark):
    f = files(spark, TEXTS)
    g = J.dependency_graph(f, f.select("path", "text"), LAYERS)
    refs = {r.path: (r.layer, r.refs) for r in g.files.collect()}
    assert refs["src/domain/user.ts"] == ("domain", 2) and refs["src/app/service.ts"] == ("app", 2) and refs["src/ui/view.ts"] == ("ui", 1) and refs["src/lone.py"] == (None, 0)
    got = [tuple(r) for r in J.layer_boundaries(g, LAYERS).collect()]
    assert got == [("enforce-layer-boundaries", "src/domain/user.ts", "layer 'domain' cannot import from layer 'app' (imported: src/app/service.ts)")]
    assert {r.path for r in J.orphaned_files(g).collect()} == {"src/lone.py"}
    assert J.orphaned_files(g, ["src/**"]).count() == 0 and J.orphaned_files(g, ["lib/**", "*.go"]).count() == 1
    assert [tuple(r) for r in J.cycles(g).collect()] == [("src/app/service.ts", 2, 2)]
    assert J.import_cycles(g, "ui").count() == 0
    empty = f.limit(0)
    none = J.dependency_graph(empty, empty.select("path", "text"), LAYERS)
    assert [J.layer_boundaries(none, LAYERS).count(), J.orphaned_files(none).count(), J.cycles(none).count()] == [0, 0, 0]


def test_rules_by_configuration(spark):
    rules = {"enforce-layer-boundaries": True, "disallow-orphaned-files": True, "disallow-import-cycles": True, "disallow-deep-relative-imports": {"max-parents": 1}, "uniqueness-constraints": {"*.py": "singleton"}, "test-adjacency": {"pattern": "adjacent", "file-patterns": ["**/*.py"]}}
    got = {(r.rule, r.path) for r in C.check(files(spark, TEXTS), C.Config(rules=rules, layers=LAYERS, entrypoints=["src/ui/**"], exclude=["notes.rs"])).collect()}
    assert {x for x in got if x[0] in C.GRAPH_RULES} == {("enforce-layer-boundaries", "src/domain/user.ts"), ("disallow-orphaned-files", "src/lone.py"), ("disallow-import-cycles", "src/app/service.ts")}
    assert ("uniqueness-constraints", "src") in got and ("test-adjacency", "src/lone.py") in got
    assert {p for r, p in got if r == "disallow-deep-relative-imports"} == {"src/domain/user.ts", "src/app/service.ts", "src/ui/view.ts", "src/ui/parts/index.ts"}


def test_directives_switch_rules_off(spark):
    t = spark.createDataFrame([("a.go", "// x:ignore max-depth old"), ("b.go", "// x:ignore"), ("c.go", "// x:no-test made"), ("d.go", "")], "path string, text string")
    left = lambda rule: {r.path for r in J.not_ignored(t, code.directives(t, "x"), rule).collect()}
    assert left("max-depth") == {"c.go", "d.go"} and left("test-location") == {"a.go", "d.go"} and left("naming-convention") == {"a.go", "c.go", "d.go"}


def test_directives_free_files_of_any_rule(spark):
    texts = {"src/BadName.py": "# @sylva:ignore naming-convention legacy", "src/Worse.py": "", "src/a/b/c/deep.py": "# @sylva:ignore naming-convention max-depth", "src/a/b/c/All_Free.py": "# @sylva:ignore", "src/a/b/c/Seen.py": "# @sylva:ignore max-depth"}
    rules = {"max-depth": {"max": 2}, "naming-convention": {"*.py": "snake_case"}}
    got = {(r.rule, r.path) for r in C.check(files(spark, texts), C.Config(rules=rules)).collect()}
    assert {x for x in got if x[1].endswith(".py")} == {("naming-convention", "src/Worse.py"), ("naming-convention", "src/a/b/c/Seen.py")}
    bare = files(spark, texts).drop("text")
    assert ("max-depth", "src/a/b/c/deep.py") in {(r.rule, r.path) for r in C.check(bare, C.Config(rules=rules)).collect()}


def test_path_layers(spark):
    paths = ["src/presentation/view.py", "src/presentation/data/cache.py", "src/business/service.py", "src/data/repo.py"]
    layers = [{"name": "presentation", "patterns": ["src/presentation/**"], "canDependOn": ["business"]}, {"name": "business", "patterns": ["src/business/**"], "canDependOn": ["data"]}, {"name": "data", "patterns": ["src/data/**"]}]
    assert [r.path for r in J.path_layers(files(spark, paths), layers).collect()] == ["src/presentation/data/cache.py"]
    layers[0]["forbiddenPaths"] = ["**/data/**"]
    (r,) = J.path_layers(files(spark, paths), layers).collect()
    assert r.message == "layer 'presentation' file contains forbidden path pattern '**/data/**'"
    assert [J.segment(p) for p in ("src/data/**", "**/x/**", "a/b*")] == ["/data/", None, "/b/"]


@pytest.mark.parametrize("name,source", [("formatter_pbt_test.go", "formatter"), ("test_pbt.py", "test"), ("FileTest.java", "File"), ("a.test.ts", "a"), ("_test.go", ""), ("plain.py", "plain")])
def test_source_names(spark, name, source):
    assert spark.range(1).select(J.source_name(F.lit(name))).first()[0] == source


def test_places_of_tests(spark):
    f = files(spark, ["a/x.go", "a/x_test.go", "a/y_test.go", "tests/z_test.go", "b/f.py", "tests/b/test_f.py", "b/g.py"])
    got = {r.path for r in J.test_location(f, ["**"], "tests").collect()}
    assert got == {"a/y_test.go"}
    assert {r.path for r in J.test_adjacency(f, ["**/*.py"], "tests").collect()} == {"b/g.py"}
    assert {r.path for r in J.test_adjacency(f, ["**/*.go"]).collect()} == set()
