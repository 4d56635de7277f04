import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sylva.llm import op12_alignment as op

A, B = public_tokenizers.path(op.A_FILE), public_tokenizers.path(op.B_FILE)
COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(rows):
    """Each text encoded whole, groups by a walk over both rows of ends."""
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    letter = op.byte_letters()
    docs, counts = [], Counter()
    for i, text in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        a_bytes = [bytes(letter[c] for c in a_tok.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(b_tok.id_to_piece(x)[3:5], 16)]) if b_tok.is_byte(x) else b_tok.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            docs.append((i, [], [], [], []))
            continue
        ends_a, ends_b = ({}, {})
        for ids, ends in ((a_bytes, ends_a), (b_bytes, ends_b)):
            at = 0
            for k, x in enumerate(ids):
                at += len(x)
                ends[at] = k
        groups, links, x, y = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(f"{','.join(map(str, a[x : ends_a[end] + 1]))}|{','.join(map(str, b[y : ends_b[end] + 1]))}")
            x, y = ends_a[end] + 1, ends_b[end] + 1
            links.append((a[x - 1], b[y - 1]))
        counts.update(links)
        docs.append((i, a, b, groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(i, len(a), len(b), len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, k in docs]


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
@pytest.mark.parametrize("limit", [op.TABLE_PAIRS, 40, 0])
def test_equals_the_libraries(request, table, limit):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    same(op.align_tokens(df, A, B, limit).select(*COLS).collect(), plain(rows))


def test_odd_texts(spark):
    texts = ["a▁b c", "▁", "  two  blanks   here ", "\n\nlines\n \n\t tab\r\n", " x　y z\xa0 w", "x\x1cy \x1d z\x00q", "<s> </s> <|endoftext|> <unk> <0x41>", "́combining é ́x", "日本語のテキスト 中文", "\U0001f600\U0001f468‍\U0001f469", "don't 'll  it's", "ﬁ Å ①", "trailing \n", " ", "\n", "x" * 5000, "1234567 " * 300, "end sep\u0085nel"]
    rows = list(enumerate(texts)) * 2 + [(99, None), (None, "null id"), (98, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'clash' as row", "1 as pair", "2 as n")
    for limit in (op.TABLE_PAIRS, 20):
        same(op.align_tokens(df, A, B, limit).select(*COLS).collect(), plain(rows))


def test_a_small_cache_gives_the_same(monkeypatch):
    models = [open(p, "rb").read() for p in (A, B)]
    rows = [f"word{i} other {i * 7} again\nline {i % 5}  two" for i in range(200)]
    whole = op.Aligner(*models).documents(rows)
    monkeypatch.setattr(op, "CACHE_UNITS", 30)
    small = op.Aligner(*models)
    parts = [small.documents(rows[i : i + 7]) for i in range(0, 200, 7)]
    for name in ("groups_sha256", "links", "n_a", "n_b", "n_groups"):
        assert [x for p in parts for x in p[name]] == list(whole[name])


def test_components_are_the_smallest_nodes():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (50, 20), (200, 400)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        label = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b):
                label[x] = label[y] = min(label[x], label[y])
        assert op.components(n, a, b).tolist() == label
