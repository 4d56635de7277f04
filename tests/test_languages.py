"""Languages by manifest and the profile of tests."""

from pyspark.sql import functions as F

from sylva.operators import languages, structure as S


def files(spark, texts):
    return S.files_from(spark.createDataFrame(list(texts.items()), "p string, text string"), F.col("p"))


def test_nearest_manifest(spark):
    texts = {
        "go.mod": "", "main.go": "", "web/package.json": '{"devDependencies": {"typescript": "5"}}', "web/src/a/b.ts": "", "web/api/setup.py": "", "web/api/pyproject.toml": "",
        "web/api/x/y.py": "", "app/package.json": '{"dependencies": {"react": "19"}}', "app/tsconfig.json": "", "app/v.tsx": "", "old/package.json": "not json", "old/v.js": "",
        "lib/Own.csproj": "", "lib/a/b/c/D.cs": "", "node_modules/x/package.json": "{}", "node_modules/x/i.js": "", "both/go.mod": "", "both/Cargo.toml": "", "both/m.rs": "",
    }
    got = {r.path: (r.root, r.language) for r in languages.nearest_manifest(files(spark, texts)).collect()}
    assert got["main.go"] == ("", "go") and got["web/src/a/b.ts"] == ("web", "typescript") and got["web/api/x/y.py"] == ("web/api", "python")
    assert got["app/v.tsx"] == ("app", "typescript") and got["old/v.js"] == ("old", "javascript") and got["lib/a/b/c/D.cs"] == ("lib", "csharp")
    assert got["node_modules/x/i.js"] == ("", "go") and got["both/m.rs"] == ("both", "rust")
    assert {r.root: r.manifest for r in languages.manifests(files(spark, texts)).collect()}["web/api"] == "web/api/pyproject.toml"
    assert languages.nearest_manifest(files(spark, {"a/b.go": ""})).first().root is None


def test_profile_of_tests(spark):
    paths = ["a/x.go", "a/x_test.go", "b/y_test.go", "tests/test_one.py", "tests/Integration_all/deep/test_two.py", "src/one.py", "w/a.ts", "w/a.spec.ts", "w/__tests__/b.test.ts", "z/test/c.spec.ts", "K.java", "KTest.java", "m.txt", "odd..spec.ts"]
    got = {r.language: tuple(r)[1:] for r in languages.test_profile(files(spark, dict.fromkeys(paths))).collect()}
    assert got["go"] == (3, 2, "adjacent", None, None)
    assert got["python"] == (3, 2, "separate", "tests", "tests/Integration_all")
    assert got["typescript"] == (5, 4, "separate", "__tests__", None)
    assert got["java"] == (2, 1, "adjacent", None, None)
