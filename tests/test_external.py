"""Rules that fail and outside programs: each is a violation of its own and leaves the others alone."""

import sys

from pyspark.sql import functions as F

from sylva.operators import structure as S
from sylva.plans import config as C
from sylva.plans.external import FAILED, asked, external_rule

GOOD = [sys.executable, "-c", "import json, sys\nx = json.load(sys.stdin)\nprint(json.dumps([{'Path': f, 'Message': x['config']['say']} for f in x['files'] if f.endswith('.tmp')]))"]
OWN_NAME = [sys.executable, "-c", "print('[{\"rule\": \"other\", \"path\": \"p\", \"message\": \"m\"}]')"]


def files(spark, paths):
    return S.files_from(spark.createDataFrame([(p,) for p in paths], "p string"), F.col("p"))


def test_answers_and_failures():
    assert asked("r", GOOD, {"say": "no"}, ["a.tmp", "b.go"], 30) == [("r", "a.tmp", "no")]
    assert asked("r", OWN_NAME, {}, [], 30) == [("other", "p", "m")]
    for command, what in (([sys.executable, "-c", "import time; time.sleep(60)"], "timed out"), ([sys.executable, "-c", "import sys; sys.exit('broken')"], "broken"), ([sys.executable, "-c", "print('not json')"], "Expecting"), (["/no/such/program"], "No such file")):
        ((rule, path, message),) = asked("r", command, {}, ["a"], 0.8 if what == "timed out" else 30)
        assert (rule, path) == ("r", ".") and message.startswith(FAILED) and what in message
    assert asked("r", [sys.executable, "-c", "print('null')"], {}, ["a"], 30) == []


def test_batches_go_through_the_program(spark):
    df = files(spark, [f"d/{i}.tmp" for i in range(25)] + ["x.go"])
    got = sorted(r.path for r in external_rule(df, "no-tmp", GOOD, {"say": "no"}, batch_files=4).collect())
    assert got == sorted(f"d/{i}.tmp" for i in range(25))
    assert external_rule(df.limit(0), "no-tmp", GOOD, {"say": "no"}).count() == 0


def test_a_failing_rule_leaves_the_others(spark):
    rules = {"max-depth": {"most": 1}, "no-tmp": {"command": GOOD, "config": {"say": "temporary"}}, "hangs": {"command": [sys.executable, "-c", "while True: pass"], "seconds": 0.8}, "symlinks": True, "max-files-in-dir": {"max": 1}}
    found = {(r.rule, r.path): r.message for r in C.check(files(spark, ["a/x.tmp", "a/y.go"]), C.Config(rules=rules)).collect()}
    assert found["no-tmp", "a/x.tmp"] == "temporary" and ("max-files-in-dir", "a") in found
    assert found["max-depth", "."].startswith("rule failed: KeyError") and "timed out" in found["hangs", "."]
