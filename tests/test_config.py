"""Excluded paths aren't reported."""

from pyspark.sql import functions as F

from sylva.operators import structure as S
from sylva.plans import config as C


def test_check_leaves_out_what_is_excluded(spark):
    paths = ["a/b/c.py", "out/x/y.py", "a/gen/z/deep.py", "a/b/n.log", "outer/k/l.py", "gen.py"]
    files = S.files_from(spark.createDataFrame([(p,) for p in paths], "p string"), F.col("p"))
    rules = {"max-depth": {"max": 1}}
    found = lambda c: {r["path"] for r in C.check(files, c).collect()}
    assert found(C.Config(rules=rules)) == {*paths} - {"gen.py"}
    config = C.with_gitignore(C.Config(rules=rules, exclude=["out/", "a/gen"]), ["*.log"])
    assert found(config) == {"a/b/c.py", "outer/k/l.py"}
