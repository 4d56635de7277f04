"""Clones: all pairs of a query set, all places of a passage."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from sylva.operators import clones
from sylva.sources import code


def test_semantic_clones_compare_queries_with_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    e = rng.normal(size=(90, 6))
    e[7] = e[40]  # a smaller id of another label, which is no query
    e[60] = 2 * e[20]  # two queries
    e[33] = 0
    rows = [(i, [float(x) for x in e[i]], i % 3) for i in range(90)]
    n = np.linalg.norm(e, axis=1)
    want = sorted((-round(float(e[a] @ e[b] / (n[a] * n[b])), 5), a, b) for a in range(0, 90, 20) for b in range(90) if a != b and 33 not in (a, b) and (b % 20 or a < b))
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("embedding", F.col("embedding").cast("array<double>"))
    for block, limit in ((1024, 30), (7, 30), (7, 1000)):
        monkeypatch.setattr(code, "BLOCK", block)
        got = [(-r["similarity"], r["a"], r["b"]) for r in code.semantic_clones(vectors, limit).collect()]
        assert [x[1:] for x in got] == [x[1:] for x in want[:limit]] and np.allclose([x[0] for x in got], [x[0] for x in want[:limit]], atol=2e-5)


def matches(texts, gram, k):
    """All maximal equal runs of k-grams, over all pairs of places; gram(text, pos) names a k-gram, or None."""
    places = [(d, p) for d, t in texts.items() for p in range(len(t) - k + 1)]
    same = {(x, y) for x, y in itertools.combinations(places, 2) if gram(*x) is not None and gram(*x) == gram(*y)}
    step = lambda x, n: (x[0], x[1] + n)
    out = set()
    for x, y in same:
        if (step(x, -1), step(y, -1)) not in same:
            n = 1
            while (step(x, n), step(y, n)) in same:
                n += 1
            out.add((x, y, n + k - 1))
    return out


def test_passages_hold_all_places_and_give_all_maximal_matches(spark):
    rng, k = np.random.default_rng(8), 3
    texts = {d: [str(x) for x in rng.integers(0, 3, rng.integers(0, 25))] for d in range(12)}
    texts |= {20: "a b c d e f g h".split(), 21: "x c d e f y".split(), 22: "a b c d e f g h".split(), 23: "q r s t q r s t u v u v u v u v".split(), 24: ["z"] * 9}
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id bigint, text string")
    found = clones.passages(df, "doc_id", F.filter(F.split("text", " "), lambda x: x != ""), k)
    rows = found.collect()
    at = {}
    for r in rows:
        for i in range(r["tokens"] - k + 1):
            assert (r["doc_id"], r["start"] + i) not in at
            at[r["doc_id"], r["start"] + i] = (r["passage"], i)
    want = matches(texts, lambda d, p: tuple(texts[d][p : p + k]), k)
    assert matches(texts, lambda d, p: at.get((d, p)), k) == want and any(x[0] == y[0] for x, y, _ in want)
    assert ((20, 0), (22, 0), 8) in want  # document 21 shares a part of it


def test_pairs_are_as_long_as_both_texts_agree(spark):
    w = [f"w{i}" for i in range(100)]
    texts = {0: ["q", *w[70:80], "r"], 1: w, 2: ["x", *w[40:60], "y"], 3: ["z", *w, "z"], 4: [*w[:10], "u", *w[:10], "u", *w[:10]]}
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id bigint, text string")
    grams = clones.kgrams(df, "doc_id", F.split("text", " "), 5)
    got = {tuple(r) for r in clones.clone_pairs(grams, "doc_id", 5).collect()}
    assert {(1, 3, 0, 1, 100), (1, 2, 40, 1, 20), (1, 4, 0, 0, 10), (4, 4, 0, 11, 15), (0, 1, 1, 70, 10), (0, 3, 1, 71, 10)} <= got
    assert all(texts[a][s : s + n] == texts[b][t : t + n] for a, b, s, t, n in got)
    assert not any(r[4] < 12 for r in clones.clone_pairs(grams, "doc_id", 5, min_tokens=12).collect())


def test_pairs_lose_no_link(spark):
    rng, k = np.random.default_rng(8), 3
    texts = {d: [str(x) for x in rng.integers(0, 4, rng.integers(0, 25))] for d in range(12)} | {24: ["z"] * 9}
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id bigint, text string")
    grams = clones.kgrams(df, "doc_id", F.filter(F.split("text", " "), lambda x: x != ""), k)
    at = {}
    for d, t in texts.items():
        for p in range(len(t) - k + 1):
            at.setdefault(tuple(t[p : p + k]), []).append((d, p))
    parent = {x: x for v in at.values() for x in v}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in clones.clone_pairs(grams, "doc_id", k).collect():
        for i in range(r["tokens"] - k + 1):
            parent[find((r["b"], r["start_b"] + i))] = find((r["a"], r["start_a"] + i))
    assert all(len({find(x) for x in v}) == 1 for v in at.values())


def test_repeated_grams_hold_every_place_of_every_repeated_gram(spark):
    """Against all digests: the same repeated k-grams with the same places, whichever the leading runs; null and repeated keys."""
    rng, k = np.random.default_rng(9), 6
    rows = [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 40)))) for i in range(60)] + [(None, "a b c a b c a b c a b c"), (7, "z " * 30), (7, "z " * 30), (90, None), (91, " ".join(str(x) for x in range(50)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    tokens = F.filter(F.split("text", " "), lambda x: x != "")
    several = lambda g: g.join(g.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "h", "left_semi")
    want = sorted(((r.doc_id is None, r.doc_id, r.pos, bytes(r.h)) for r in several(clones.kgrams(df, "doc_id", tokens, k)).collect()), key=str)
    for lead in (2, 4, 6):
        found = clones.repeated_grams(df, "doc_id", tokens, k, lead)
        got = sorted(((r.doc_id is None, r.doc_id, r.pos, bytes(r.h)) for r in several(found).collect()), key=str)
        assert got == want and not found.where("doc_id = 91").count()
        assert found.where("pos = 0 and before is not null or pos > 0 and before is null").count() == 0


def test_code_clones_by_type_tokens_and_lines(spark):
    body = "func {f}({x} int) (string, error) {{\n\tif {x} <= {n} && ok() {{ // {c}\n\t\treturn {s}, nil\n\t}}\n\tfor i := 0; i < {x}; i++ {{\n\t\tsum += i\n\t}}\n\treturn \"\", err\n}}\n"
    one = body.format(f="First", x="a", n=10, s='"x"', c="a note")
    texts = {
        "a.go": "package a\n\n" + one,
        "b.go": "package b\n/* some\nlines */\nvar k = 1\n" + one.replace("// a note", "/* other */").replace("\t", "  "),
        "c.go": "package c\n" + body.format(f="Other", x="size", n="0xff", s="`raw\nstring`", c="x"),
        "d.go": "package d\nfunc small() { return }\n",
        "e.go": None,
    }
    df = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = {(r.a, r.b): r for r in clones.code_clones(df, k=20).collect()}
    assert set(got) == {("a.go", "b.go"), ("a.go", "c.go")}
    exact, renamed = got["a.go", "b.go"], got["a.go", "c.go"]
    assert exact.type == "exact" and exact.line_a == 3 and exact.line_b == 5 and exact.lines == 9
    assert renamed.type == "renamed" and renamed.tokens >= exact.tokens and renamed.lines == 11
    assert clones.code_clones(df, k=20, min_lines=30).count() == clones.code_clones(df, k=20, min_tokens=400).count() == 0


def test_lexer():
    from sylva.sources.lexer import tokens

    raw, normal, line = tokens('x := a.b[0x1F] // no\n/* n\n** o */ if s != `r\n"q"` && c == \'\\n\' { y &^= .5 }\nétat <- "\\"s"')
    assert raw == ["x", ":=", "a", ".", "b", "[", "0x1F", "]", "if", "s", "!=", '`r\n"q"`', "&&", "c", "==", "'\\n'", "{", "y", "&^=", ".5", "}", "état", "<-", '"\\"s"']
    assert normal == ["_ID_", ":=", "_ID_", ".", "_ID_", "[", "_LIT_", "]", "if", "_ID_", "!=", "_LIT_", "&&", "_ID_", "==", "_LIT_", "{", "_ID_", "&^=", "_LIT_", "}", "_ID_", "<-", "_LIT_"]
    assert line == [1] * 8 + [3] * 4 + [4] * 9 + [5] * 3


def test_pairs_compare_texts_once(spark, monkeypatch):
    """A pair's texts meet in one row for all their diagonals, without a row a place; copies of a frequent text are spread."""
    rng, k = np.random.default_rng(3), 4
    texts = {d: [str(x) for x in rng.integers(0, 3, 40)] for d in range(6)} | {10 + d: [f"c{i}" for i in range(30)] for d in range(9)}
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id bigint, text string")
    split = F.filter(F.split("text", " "), lambda x: x != "")
    monkeypatch.setattr(clones, "PAIRS_A_COPY", 2)
    held = clones.clone_pairs(clones.repeated_texts(df, "doc_id", split, k), "doc_id", k)
    assert "Window" not in held._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in held.collect())
    monkeypatch.setattr(clones, "PAIRS_A_COPY", 256)
    assert got == sorted(tuple(r) for r in clones.clone_pairs(clones.kgrams(df, "doc_id", split, k), "doc_id", k).collect())
    grams = {}
    for d in sorted(texts):
        for p in range(len(texts[d]) - k + 1):
            grams.setdefault(tuple(texts[d][p : p + k]), {}).setdefault(d, []).append(p)
    want, links = [], set()
    for docs in grams.values():
        a, b = min(docs), list(docs)
        links |= {(a, x, docs[x][0] - docs[a][0]) for x in b if x != a}
    same = {(a, b, s, p) for a, b, s in links for p in range(len(texts[a]) - k + 1) if 0 <= p + s <= len(texts[b]) - k and texts[a][p : p + k] == texts[b][p + s : p + s + k]}
    same |= {(d, d, p - at[0], at[0]) for docs in grams.values() for d, at in docs.items() for p in at[1:]}
    for a, b, s, p in same:
        if (a, b, s, p - 1) not in same:
            n = 1
            while (a, b, s, p + n) in same:
                n += 1
            want.append((a, b, p, p + s, n + k - 1))
    assert got == sorted(want) and (10, 18, 0, 0, 30) in got


ODD = [(1, "a b c d e f g"), (2, "x a b c d e y"), (2, "x a b c d e y"), (3, None), (4, "a b"), (5, "z z z z z z z"), (None, "a b c d q r s"), (None, "q r s t"), (6, "m n o p"), (7, "")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string"), F.filter(F.split("text", " "), lambda x: x != "")


def exchanges(df, by):
    return df._jdf.queryExecution().executedPlan().toString().count(f"Exchange hashpartitioning({by}#")


def test_index_counts_all_grams_and_shuffles_the_repeated_only(spark):
    """Single k-grams are counted without being dealt; an empty table has none."""
    df, tokens = odd(spark)
    for k in (3, 4, 7):
        n = {}
        for _, text in ODD:
            t = (text or "").split()
            for i in range(len(t) - k + 1):
                n[tuple(t[i : i + k])] = n.get(tuple(t[i : i + k]), 0) + 1
        assert tuple(clones.index_stats(df, "doc_id", tokens, k).first()) == (len(n), sum(n.values()), sum(x > 1 for x in n.values()))
        found = clones.repeated_grams(df, "doc_id", tokens, k)
        assert found.count() < sum(n.values())
    assert tuple(clones.index_stats(df.limit(0), "doc_id", tokens, 3).first()) == (0, None, 0)


def test_grams_are_dealt_once_and_written_once(spark, monkeypatch):
    """Collisions take one exchange by k-gram and no table; pairs one exchange by k-gram, a table of texts and one of pairs."""
    df, tokens = odd(spark)
    written, cut = [], clones.cut
    monkeypatch.setattr(clones, "cut", lambda x: written.append(x) or cut(x))
    found = clones.collisions(clones.repeated_grams(df, "doc_id", tokens, 4), "doc_id")
    assert exchanges(found, "h") == 1 and not written
    assert {(r.n, r.docs) for r in found.collect()} == {(4, 2), (3, 2)}  # a null key is no document
    unique = df.where("doc_id in (1, 5, 6)").unionByName(df.where("doc_id = 2").distinct())
    clones.clone_pairs(clones.repeated_texts(unique, "doc_id", tokens, 4), "doc_id", 4).collect()
    assert len(written) == 2 and exchanges(written[1], "h") == 1


def test_slices_hold_texts_whole(monkeypatch):
    """Only a text of more tokens than are hashed at once is a slice of its own that is hashed in parts."""
    import pyarrow as pa

    monkeypatch.setattr(clones, "AT_ONCE", 10)
    sizes = [4, 4, 4, 0, 25, 1, 9, 10, 11, 3]
    batch = pa.RecordBatch.from_arrays([pa.array([["w"] * n if n else None for n in sizes])], names=["t"])
    parts = [[len(x or ()) for x in part.column("t").to_pylist()] for part, _ in clones._sliced([batch])]
    assert parts == [[4, 4], [4, 0], [25], [1, 9], [10], [11], [3]]


def test_texts_of_several_rows_are_put_together_others_stay(spark, monkeypatch):
    """A text longer than what is hashed at once, and a repeated or null key, end as one row with its places in order."""
    long = " ".join(f"w{i % 7}" for i in range(clones.AT_ONCE + 50))
    df = spark.createDataFrame([(1, long), (2, "w0 w1 w2 w3 w4"), (3, "p q r s"), (3, "p q r s t"), (None, "p q r s"), (None, "q r s t")], "doc_id bigint, text string")
    found = clones.repeated_texts(df, "doc_id", F.split("text", " "), 4)
    assert found.where("doc_id = 1").count() == 2
    rows = {r.doc_id: (r.pos, len(r.s)) for r in clones._texts(found, "doc_id").collect()}
    n = clones.AT_ONCE + 50 - 3
    assert rows == {1: (list(range(n)), n), 2: ([0, 1], 2), 3: ([0, 0, 1], 3), None: ([0, 0], 2)}
    written, cut = [], clones.cut
    monkeypatch.setattr(clones, "cut", lambda x: written.append(x) or cut(x))
    assert clones._texts(found.where("doc_id = 2"), "doc_id").count() == 1 and len(written) == 1


def test_code_of_any_size_is_compared_by_chunks(spark, monkeypatch):
    """No row holds more than a chunk, wherever a file is cut into rows; passages across borders are whole, with their lines and type."""
    from sylva.sources import lexer

    rng, k = np.random.default_rng(11), 4
    bits = ["a ", "b ", "1 ", "if ", "+ ", "; ", "\n", "// x\n", "/* y\n */", "`r\nr` "]
    body = "".join(rng.choice(bits, 90))
    texts = {f"f{i}.go": "".join(rng.choice(bits, rng.integers(0, 150))) for i in range(5)}
    texts |= {"g.go": body, "h.go": "x := 2\n" + body.replace("a ", "c "), "i.go": body[40:] + body + body + "\n`open /* ", "j.go": ""}
    cuts = {p: sorted({0, len(t), *rng.integers(0, len(t) + 1, 6).tolist()}) for p, t in texts.items()}
    rows = [(p, n, texts[p][x:y]) for p, c in cuts.items() for n, (x, y) in enumerate(zip(c, c[1:]))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(p, int(n), t) for p, n, t in rows] + [(None, 0, body), ("j.go", 9, None)], "path string, n int, text string")

    raw, t, line = ({p: lexer.tokens(x)[f] for p, x in texts.items()} for f in range(3))
    grams = {}
    for p in sorted(t):
        for i in range(len(t[p]) - k + 1):
            grams.setdefault(tuple(t[p][i : i + k]), {}).setdefault(p, []).append(i)
    links = {(min(g), p, at[0] - g[min(g)][0]) for g in grams.values() for p, at in g.items() if p != min(g)}
    same = {(a, b, s, i) for a, b, s in links for i in range(len(t[a]) - k + 1) if 0 <= i + s <= len(t[b]) - k and t[a][i : i + k] == t[b][i + s : i + s + k]}
    same |= {(p, p, i - at[0], at[0]) for g in grams.values() for p, at in g.items() for i in at[1:]}
    want = []
    for a, b, s, i in same:
        if (a, b, s, i - 1) not in same:
            n = 1
            while (a, b, s, i + n) in same:
                n += 1
            n += k - 1
            lines = line[a][i + n - 1] - line[a][i] + 1
            want.append((a, b, i, i + s, n, line[a][i], line[b][i + s], lines, "exact" if raw[a][i : i + n] == raw[b][i + s : i + s + n] else "renamed"))
    assert max(x[4] for x in want) > 40 and {x[8] for x in want} == {"exact", "renamed"} and any(x[0] == x[1] for x in want)
    written, cut = [], clones.cut
    monkeypatch.setattr(clones, "cut", lambda x, **options: written.append(cut(x, **options)) or written[-1])
    for chunk, step, copies, least, lines in ((13, 7, 2, 0, 0), (40, 30, 256, 9, 3), (1 << 15, 1 << 20, 256, 0, 0)):
        for module, name, x in ((clones, "CHUNK", chunk), (clones, "PAIRS_A_COPY", copies), (lexer, "STEP", step)):
            monkeypatch.setattr(module, name, x)
        written.clear()
        got = [tuple(r) for r in clones.code_clones(df, k, least, lines, order=("n",)).collect()]
        assert sorted(got) == sorted(x for x in want if x[4] >= least and x[7] >= lines)
        assert written[0].selectExpr("max(length(t))", "max(length(raw))").first() <= (4 * (chunk + k - 1), 8 * chunk)


def test_scanner_of_parts_gives_the_tokens_of_the_whole():
    from sylva.sources import lexer

    rng = np.random.default_rng(5)
    bits = ["`", '"', "'", "\\", "\n", "/*", "*/", "//", "a", "func", "12", ".5", "..", ".", "&^", "=", "<", "<<", " ", "é", "*", "/", ":="]
    hashes = lexer._Hashes()
    for _ in range(2000):
        text = "".join(rng.choice(bits, rng.integers(0, 25)))
        raw, normal, line = lexer.tokens(text)
        scanner, got, n = lexer.Scanner(hashes), [[], [], []], int(rng.integers(1, 6))
        for i in range(0, len(text) + n, n):
            for x, y in zip(got, scanner.scan(text[i : i + n], i >= len(text))):
                x += y.tolist()
        assert got == [[lexer.CODES.get(x) or ord(x) for x in normal], [hashes[x] for x in raw], line]
