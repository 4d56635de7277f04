import os

import pytest
from pyspark.sql import functions as F

from sylva.functions import paths as P
from sylva.functions.globs import gitignore_glob, glob_match
from sylva.operators import graph, metrics, predicates as R, sinks, structure as S
from sylva.plans import config as C
from sylva.sources import code
from sylva.sources.tree import TreeSource


def files(spark, *paths):
    return S.files_from(spark.createDataFrame([(p,) for p in paths], "p string"), F.col("p")).withColumn("is_symlink", F.lit(False))


@pytest.mark.parametrize("dialect,path,glob,match", [
    ("walker", "src/app.ts", "src/**/*.ts", True), ("walker", "test/app.ts", "src/**/*.ts", False), ("walker", "components/Button", "components/*/", True),
    ("walker", "subdir/file.txt", "*.txt", True), ("walker", "file.t", "file.??", False), ("walker", "file.js", "file.[tc]s", False),
    ("walker", "file+test.ts", r"file\+test.ts", True), ("walker", "node_modules/pkg/index.js", "node_modules/**", True),
    ("rules", "foo/bar/baz.go", "**/bar/*.go", True), ("rules", "foo/bar/baz.go", "**/foo/**", True), ("rules", "xy", "?", False), ("rules", "x/y/z", "?/?/*", True),
    ("rules", "Foo.go", "[a-z]*.go", False), ("rules", "Foo.go", "[!a-z]*.go", True), ("rules", "path/file.test.js", "*.test.*", True), ("rules", "m", "[z-a]", False),
    ("layer", "src/foo/bar.py", "src/**", True), ("layer", "test/foo.py", "**/test/**", True), ("layer", "src/tests/foo.py", "**/test/**", False), ("layer", "foo/bar.py", "*.py", False),
])
def test_globs(spark, dialect, path, glob, match):
    assert spark.range(1).select(glob_match(F.lit(path), glob, dialect)).first()[0] is match


def test_gitignore():
    assert [gitignore_glob(x) for x in ("node_modules", "*.log", "dist/", "/build", "!x", "# c", "")] == ["**/node_modules", "**/*.log", "dist/**", "build", None, None, None]


def test_paths(spark):
    got = spark.range(1).select(
        P.resolve_import(F.lit("src/app.ts"), F.lit("./utils")), P.resolve_import(F.lit("src/components/Button.tsx"), F.lit("../hooks/useButton")), P.resolve_import(F.lit("src/app.ts"), F.lit("react")),
        P.to_pascal(F.lit("user_service")), P.to_kebab(F.lit("UserService")), P.detect_style(F.lit("simpleword")), P.detect_style(F.lit("CONSTANT")), P.detect_style(F.lit("user_service")),
    ).first()
    assert list(got) == ["src/utils", "src/hooks/useButton", "react", "UserService", "user-service", "camelCase", "PascalCase", "snake_case"]


def test_structure_rules(spark):
    f = files(spark, "src/Foo.ts", "src/foo.ts", "src/Bar.ts", "a/b/c/d.ts", "lib/foo.ts")
    assert [r.path for r in S.case_conflicts(f).collect()] == ["src/foo.ts"]
    assert [r.path for r in S.max_files(f, 2).collect()] == ["src"]
    assert [r.path for r in S.max_depth(f, 2).collect()] == ["a/b/c/d.ts"]
    assert S.max_depth(f, 2, {"a/**": 3}).count() == 0
    assert {(r.path, r.file_count, r.subdir_count) for r in S.directories(f).collect()} == {("src", 3, 0), ("a", 0, 1), ("a/b", 0, 1), ("a/b/c", 1, 0), ("lib", 1, 0)}
    assert sorted(r.path for r in S.disallowed(f, ["**/foo.ts", "!lib/**"]).collect()) == ["src/foo.ts"]
    assert S.max_files(f.limit(0), 1).count() == 0


def test_combinators(spark):
    f = files(spark, "a.go", "b.py")
    bad, good = R.disallow_where(f, "x", R.has_extension(".go"), "m"), R.disallow_where(f, "y", R.has_extension(".rs"), "m")
    assert R.any_of("r", a=bad, b=good).count() == 0 and R.any_of("r", a=bad).count() == 1
    assert R.not_rule("r", good).count() == 1 and R.not_rule("r", bad).count() == 0
    assert R.exactly_one_of("r", a=bad, b=good).count() == 0 and R.exactly_one_of("r", a=good, b=good).count() == 1
    assert [r.rule for r in R.all_of("r", a=bad, b=good).collect()] == ["r[a]"]
    assert R.require_file(f, "r", R.name_matches("*.rs"), "m").count() == 1
    assert R.conditional(f, R.has_extension(".rs"), bad).count() == 0 and R.conditional(f, R.has_extension(".py"), bad).count() == 1
    assert sinks.json_document(bad).first()[0].count('"rule"') == 1 and sinks.junit_suites(bad).first()["failures"] == 1


def test_components_of_a_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "e")], "src string, dst string")
    assert {(r.node, r.component) for r in graph.strongly_connected(e).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e")}
    assert {(r.src, r.dst) for r in graph.cycle_edges(e).collect()} == {("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("e", "e")}
    roots = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.distance) for r in graph.reachable(e, roots, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_imports_and_directives(spark):
    rows = [
        ("a.ts", "import x from './u'\nconst y = require('react')\n// import z from 'no'"), ("b.go", 'package p\nimport (\n  "fmt"\n  q "os/exec"\n)\nfunc Run() {}\nvar s = "x"'),
        ("c.py", "from .utils import a\nimport os\ndef f():\n  pass\nclass _P: pass"), ("D.java", "package a.b;\nimport a.b.C;\nimport java.util.List;\npublic class D {}"),
        ("e.cpp", '#include "calculator.h"\n#include <vector>'), ("f.cs", "using System;\npublic class Calculator {}"),
    ]
    t = spark.createDataFrame(rows, "path string, text string")
    got = {(r.source_file, r.import_path, r.is_relative) for r in code.imports(t).collect()}
    assert got == {("a.ts", "./u", True), ("a.ts", "react", False), ("b.go", "fmt", False), ("b.go", "os/exec", False), ("c.py", ".utils", True), ("c.py", "os", False), ("D.java", "a.b.C", True), ("D.java", "java.util.List", False), ("e.cpp", "calculator.h", True), ("e.cpp", "vector", False), ("f.cs", "System", False)}
    assert {(r.source_file, r.name) for r in code.exports(t).collect()} == {("b.go", "Run"), ("c.py", "f"), ("D.java", "D"), ("f.cs", "Calculator")}
    d = spark.createDataFrame([("x.go", "// lint:ignore max-depth max-files-in-dir Legacy code\n" + "\n" * 120 + "// lint:no-test late")], "path string, text string")
    (r,) = code.directives(d, "lint").collect()
    assert (r.type, r.rules, r.reason, r.line) == ("ignore", ["max-depth", "max-files-in-dir"], "Legacy code", 1)


def test_metrics(spark):
    t = spark.createDataFrame([("f", "+", True), ("f", "a", False), ("f", "b", False), ("f", "a", False)], "file string, value string, is_operator boolean")
    h = metrics.halstead(t, "file").first()
    assert (h.n1, h.n2, h.big_n1, h.big_n2) == (1, 2, 1, 3) and h.difficulty == 0.75


def test_tree_and_config(spark, tmp_path):
    for p in ("src/__init__.py", ".github/ci.yml", "node_modules/x/y.js", "out/z.txt", "src/deep/er/f.py"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text("x")
    (tmp_path / "base.yml").write_text("rules: {max-depth: {max: 9}, symlinks: true}\nexclude: ['out/']\n")
    (tmp_path / "conf.yml").write_text("root: true\nextends: base.yml\nrules: {max-depth: {max: 2}}\n")
    c = C.find(str(tmp_path), "conf.yml")
    spark.dataSource.register(TreeSource)
    t = spark.read.format("tree").option("exclude", ",".join(c.exclude)).load(str(tmp_path))
    paths = {r.path for r in t.collect()}
    assert {"src/__init__.py", ".github/ci.yml", "src/deep/er"} <= paths and not any(p.startswith(("out", "node_modules")) for p in paths)
    assert sorted(r.path for r in C.check(t, c).collect()) == ["src/deep/er", "src/deep/er/f.py"]
    with pytest.raises(ValueError):
        C.check(t, C.Config(rules={"nope": 1}))
