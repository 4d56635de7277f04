import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from sylva.llm import op01_bpe, op02_shards, op03_quality, op04_ngram_join, op05_licenses, op06_lm, op07_token_counts, op08_pii, op09_mix, op10_exact_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


@pytest.mark.parametrize("module", [op02_shards, op09_mix, op10_exact_dedup])
@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_sql(request, module, table):
    df = request.getfixturevalue(table)
    run = {op02_shards: op02_shards.assign_shards, op09_mix: op09_mix.mix, op10_exact_dedup: op10_exact_dedup.exact_dedup}[module]
    got = run(df).toPandas()
    con = duckdb.connect()
    frame = df.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841
    con.execute("create view documents as select doc_id::BIGINT doc_id, text::VARCHAR text, lang::VARCHAR lang, source::VARCHAR source from frame")
    want = con.execute(module.SQL).df()
    cols = sorted(want.columns)
    assert len(got) == len(want)
    if len(want):
        order = lambda x: x[cols].sort_values(cols).reset_index(drop=True)
        pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, rtol=1e-9)


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_bpe_equals_the_library(request, table):
    import tiktoken

    df = request.getfixturevalue(table)
    path = public_tokenizers.path(op01_bpe.TOKENIZER)
    with open(path, "rb") as f:
        enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op01_bpe.read_ranks(f.read()), special_tokens={})
    got = op01_bpe.digests(op01_bpe.encode_decode(df, path, public_tokenizers.PATTERN, leaf=40, window=4)).collect()
    want = []
    for i, t in pairs(df):
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    same(got, want)


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_token_counts_equal_the_library(request, table):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(table)
    path = public_tokenizers.path(op07_token_counts.TOKENIZER)
    tok = Tokenizer.from_file(path)
    for rows in (op07_token_counts.TABLE_ROWS, 3):
        got = op07_token_counts.count_tokens(df, path, rows=rows).collect()
        n = {t: len(tok.encode(t, add_special_tokens=False).ids) for _, t in pairs(df)}
        same(got, [(i, len(t.encode()), n[t], n[t] > 2048) for i, t in pairs(df)])


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_quality_base(request, table):
    df = request.getfixturevalue(table)
    got = op03_quality.quality(df).collect()
    want = []
    for i, t in pairs(df):
        w = WORD.findall(t)
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        hit = {j + k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(5)}
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    same([tuple(r)[:7] for r in got], want)
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_mcd_rejects_junk_and_keeps_the_rest(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.integers(20, 300))), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(100)), "en", "s") for i in range(8)]
    got = {r["doc_id"]: r["kept"] for r in op03_quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(v == (k < 1000) for k, v in got.items())


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(t.translate(LOWER))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        least[find(x)] += [i] if i is not None else []
    return [(i, len(sets[x]), min(least[find(x)], default=None)) for x, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_jaccard_join_equals_brute_force(request, table):
    df = request.getfixturevalue(table)
    same(op04_ngram_join.jaccard_join(df).collect(), brute_components(pairs(df), 4, 85))


def test_jaccard_join_of_many_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"w{j}" for j in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for j in rng.integers(0, 60, rng.integers(0, 3)):
            w[j] = f"x{rng.integers(0, 5)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(op04_ngram_join.jaccard_join(df).collect(), brute_components(rows, 4, 85))


def test_licenses(spark, odd, none):
    fill = "lorem ipsum dolor sit amet consetetur " * 30
    rows = [(1, fill + "Released under the MIT License. " + fill), (2, fill), (3, "x " + op05_licenses.TEMPLATES["Apache-2.0"][1] + " y"), (4, fill + op05_licenses.TEMPLATES["BSD-3-Clause"][0].replace("source code", "SOURCE, code") + fill)]
    got = {r["doc_id"]: [m["name"] for m in r["matches"]] for r in op05_licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: ["MIT"], 2: [], 3: ["Apache-2.0"], 4: ["BSD-3-Clause"]}
    assert op05_licenses.scan_licenses(odd).count() == odd.count() and op05_licenses.scan_licenses(none).count() == 0


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_lm_base(request, table):
    df = request.getfixturevalue(table)
    got = op06_lm.score(df).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    rows = [(i, WORD.findall(t.translate(LOWER)) + [0]) for i, t in pairs(df)]
    c = Counter(w for i, x in rows if fold(i) != 1 for w in x)
    n, v = sum(c.values()), len(c)
    want = [(i, fold(i) == 1, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 4)) for i, x in rows]
    same([(*tuple(r)[:5], round(r["base_score"], 4)) for r in got], want)
    assert all(math.isfinite(r["score"]) for r in got)


def test_lm_beats_the_base_and_is_normalised(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{'abcd'[(i + j) % 4]}{rng.integers(0, 3)}" for j in range(800))) for i in range(500)]
    got = op06_lm.score(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").toPandas()
    assert got["score"].sum() > 0.95 * got["base_score"].sum()  # the next letter is certain, its figure is not
    model = op06_lm.LogBilinear(np.log(np.full(op06_lm.UNITS, 1 / op06_lm.UNITS)))
    first, second, norm = model.tables()
    assert abs(np.exp(first[3] + second[7] - norm[3, 7]).sum() - 1) < 1e-4


def test_pii(spark, odd, none):
    cases = {"write to john (at) example (dot) com": "john (at) example (dot) com", "mary at example dot com.": "mary at example dot com", "plus one four one five five five five two six seven one": None, "＋１ (415) 555-2671": None, "m jоhn@exаmple.com x": "jоhn@exаmple.com"}
    for text, span in cases.items():
        _, found = op08_pii.find_pii(text)
        assert len(found) == 1 and (span is None or text[found[0][1] : found[0][2]] == span)
    for clean in ("meet me at example.com", "one two three go", "we met at ten dot matrix printers"):
        assert op08_pii.find_pii(clean)[1] == []
    assert op08_pii.scan_pii(odd).count() == odd.count() and op08_pii.scan_pii(none).count() == 0


def test_pii_base_equals_the_plain_patterns(docs):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": op08_pii.is_card, "phone": lambda s: 8 <= len(op08_pii.only_digits(s)) <= 15}
    odd = ["a@b.c@d.e 1.2.3.4.5.6.7.8 300.1.1.1.1 +1 (415) 555-2671 - 4111-1111 1111 1111 4111111111111111", "@@ a@ @b.c x@y", "+" * 5 + "1" * 30, "0001.002.003.004 99999999999.1.1.1"]
    for t in odd + [t for _, t in pairs(docs)]:
        want = [(k, m.start(), m.end()) for k, p in plain.items() for m in re.finditer(p, t) if ok[k](m[0])]
        assert op08_pii.base_spans(t) == want


def test_mix_comes_near_its_targets(docs):
    m = op09_mix.mix(docs).toPandas()
    src = docs.select("doc_id", "source").toPandas()
    m = m.merge(src, on="doc_id")
    assert (m["taken"] <= 2 * m["size"]).all()
    by = m.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by["taken"] - by["target"]).abs() <= 1).all()
    assert m["position"].dropna().between(0, 1).all()


def test_dedup_survives_collisions_and_small_memtables(docs, monkeypatch):
    weak = lambda t: bytes([len(t) % 7])
    strong = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in op10_exact_dedup.exact_dedup(docs).collect()}
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in op10_exact_dedup.exact_dedup(docs, digest=weak).collect()} == strong
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in op10_exact_dedup.exact_dedup(docs, max_bytes=2000, max_rows=5).collect()} == strong
    # segments of two entries, a pass for each, and hot digests that meet level 0 by broadcast
    monkeypatch.setattr(op10_exact_dedup, "HOT_ROWS", 3)
    many = op10_exact_dedup.exact_dedup(docs, max_bytes=2000, max_rows=5, segment=2, filter_bytes=1)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in many.collect()} == strong


def test_dedup_levels(spark):
    rows = [(bytes([i % 50]) * 32, i if i % 7 else None, 1, False) for i in range(300)] + [(b"\x00" * 31 + b"\x01", 5, 4, True), (b"\xff" * 32, 9, 1, False)]
    runs = spark.createDataFrame(rows, "digest binary, keep_id bigint, n bigint, clash boolean").repartition(7)
    level = op10_exact_dedup.compact(runs, 8).collect()
    hits, filters = [r for r in level if r["bits"] is None], [r for r in level if r["bits"] is not None]
    want = {bytes([k]) * 32: (min(i for i in range(k, 300, 50) if i % 7), 6, 6, False) for k in range(50)} | {b"\x00" * 31 + b"\x01": (5, 4, 1, True)}
    assert {bytes(r["digest"]): (r["keep_id"], r["group_size"], r["runs"], r["clash"]) for r in hits} == want
    spans = sorted((bytes(r["digest"]), bytes(r["last"]), bytes(r["bits"])) for r in filters)
    assert len(spans) > 6 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    held = op10_exact_dedup.Filters(spans)
    assert held.may_hold(list(want)).all() and not held.may_hold([b"\xff" * 32, b""]).any()
    others = [hashlib.sha256(b"%d" % i).digest() for i in range(5000)]
    assert held.may_hold(others).mean() < 0.05
    of = op10_exact_dedup.passes(spark.createDataFrame(spans, "digest binary, last binary, bits binary"), 2 * len(spans[0][2]))
    assert of[0][0] is None and of[-1][1] is None and all(a[1] == b[0] for a, b in zip(of, of[1:])) and len(of) >= len(spans) // 2


def test_dedup_stages_keep_one_row(spark):
    rows = [(5, "b  b"), (3, "b b"), (5, "a"), (5, "a"), (None, "n"), (None, "n"), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    same([(r["doc_id"], " ".join((r["text"] or "").split())) for r in op10_exact_dedup.drop_duplicates(df).collect()], [(3, "b b"), (5, "a"), (None, "n"), (8, "")])
    rows = [(1, "one two three four five"), (1, "One two three four  five"), (2, "one two three four five"), (3, "six"), (4, None)]
    got = op04_ngram_join.keep_representatives(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    same([(r["doc_id"],) for r in got], [(1,), (3,), (4,)])


def test_shards_fit(docs):
    for limit in (3000, 50_000):
        got = op02_shards.assign_shards(docs, limit).toPandas()
        by = got.groupby("shard").agg(b=("n_bytes", "sum"), docs=("doc_id", "count"), over=("oversize", "first"), said=("shard_bytes", "first"))
        assert (by["b"] == by["said"]).all() and ((by["b"] <= limit) | (by["over"] & (by["docs"] == 1))).all() and len(got) == docs.count()


def test_pipeline(spark, odd):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns, name
