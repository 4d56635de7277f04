import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from sylva.llm import op13_suffixes as op

COLS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def plain(rows, span):
    """All strings of span bytes in a dictionary."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(x[k : k + span] for _, x in texts for k in range(len(x) - span + 1))
    out = []
    for i, x in texts:
        gone = bytearray(len(x))
        for k in range(len(x) - span + 1):
            if seen[x[k : k + span]] > 1:
                gone[k : k + span] = b"\1" * span
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def run(df, **kw):
    return Counter(map(tuple, op.remove_repeats(df, **kw).select(*COLS).collect()))


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_whole_spans(request, table):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert run(df) == plain(rows, op.SPAN)


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"size": 500, "bucket_rows": 20}), (3, {"size": 60, "bucket_rows": 5})])
def test_short_spans_and_many_borders(spark, seed, kw):
    """Passages inside texts, with edges of any length, periodic texts, copies; small pieces, so that most tokens go over borders."""
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    passages = [letters(rng.randint(15, 90)) for _ in range(12)]
    rows = [(i, letters(rng.randint(0, 30)).join(rng.sample(passages, rng.randint(0, 4)) + [letters(8)])) for i in range(150)]
    rows += [(i, letters(6) + passages[0] + letters(6)) for i in range(200, 280)] + [(300, "ab" * 60), (301, "x" * 70), (302, "x" * 25), (303, None), (None, rows[3][1]), (5, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'clash' as id", "1 as key", "2 as at")
    assert run(df, span=20, anchor=6, **kw) == plain(rows, 20)


def test_long_text(spark):
    """A text of several segments, a passage of it elsewhere, and one of a single letter."""
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3 * op.SEGMENT))
    rows = [(1, text), (2, "start " + text[op.SEGMENT - 150 : op.SEGMENT + 150] + " end"), (3, text[-250:]), (4, "a" * 20_000), (5, "word " * 5000)]
    assert run(spark.createDataFrame(rows, "doc_id bigint, text string")) == plain(rows, op.SPAN)


def test_multikey_sort():
    rng = np.random.default_rng(5)
    raw = bytes(rng.integers(97, 99, 400).astype(np.uint8))
    start, group = np.arange(380), rng.integers(0, 3, 380)
    same = op.multikey_sort(op.big_endian_words(raw), start, group, [0, 2])
    seen = Counter((int(g), raw[s : s + 10]) for s, g in zip(start, group))
    assert same.tolist() == [seen[int(g), raw[s : s + 10]] > 1 for s, g in zip(start, group)]


def test_sql(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    got = op.query(spark, sf).select(*COLS).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert Counter(map(tuple, got)) == Counter(map(tuple, con.execute(f"select {', '.join(COLS)} from ({op.SQL})").fetchall()))
