import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from sylva.llm import op11_prefix_trie as op

COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The trie by dictionaries; rows: conv_id, turn, role, text."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            d = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, d, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(int(c / 5) * 5, [])[:h] + turns[h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(full[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumn("key", df["text"]).withColumn("donor", df["turn"]).withColumn("n", df["role"])
    return sorted(map(tuple, op.prefix_trie(df, **kw).select(*COLS).collect()))


def made(seed, convs=120, long=0):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-40, 400), convs):
        for turn in range(long if long and c % 7 == 0 else rng.randint(1, 14)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é" * 3, None, ""]) if turn > 1 else "hot"))
    return rows


@pytest.mark.parametrize("kw", [{}, {"part_turns": 40, "chunk_ids": 3, "waiting": 5, "fan": 3}, {"part_turns": 9, "chunk_ids": 1, "waiting": 1, "fan": 2}])
def test_equals_dictionaries(spark, kw):
    rows = made(1)
    assert run(spark, rows, **kw) == plain(rows)


def test_copies_over_many_partitions(spark):
    rows = [(5 * c, t, "user", f"t{t}") for c in range(150) for t in range(3)] + [(5 * c, t, "user", f"u{t}") for c in range(200, 230) for t in range(12)]
    assert run(spark, rows, part_turns=25, chunk_ids=4, waiting=3, fan=2) == plain(rows)


def test_nulls_ties_and_empty(spark):
    rows = [(1, None, "a", "x"), (1, 0, "a", None), (1, 0, "a", None), (2, 1, None, "y"), (2, 1, "b", "y"), (None, 0, "a", "lost"), (0, 3, "a", "x"), (0, None, None, None), (7, 1, "u", "t" * 100_000)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, part_turns=2, fan=2) == plain(rows)
    assert run(spark, [(None, 0, "a", "b")]) == []


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = op.query(spark, sf).toPandas()[sorted(COLS)]
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(op.SQL).df()[sorted(COLS)]
    order = lambda x: x.astype({"parent_conv_id": "float64"}).sort_values(["depth", "conv_id"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
