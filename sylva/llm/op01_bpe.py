"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until a part has at most LEAF characters; leaves are encoded by the library. Two neighbours are joined
by encoding a window around their border anew: it starts at a cut in the left part and ends at one in the right part.
A cut is a place where a blank follows a character that is none. The pattern has no alternative in which a blank follows
other characters, and none looks back, so every scan that reaches such a place begins a new match there, whatever stands
before or after: the tokens left of the first cut and right of the second are those of the whole text. If a part has no
cut within the window, the window grows fourfold, at last to the whole part. Decoding turns leaves of ids into bytes and
concatenates them up the tree.

Defined results: null text counts as empty (0 tokens, the digests of nothing); null doc_ids are kept; repeated rows are
encoded each; an empty table gives an empty table; other columns are ignored. A text is encoded in one task, in memory
that grows with its length only.
"""

from __future__ import annotations

import base64
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import map_batches, only, table, texts

LEAF, WINDOW, LEAF_IDS = 4096, 64, 4096
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
_CUT = re.compile(r"\S[ \n]")

_codecs: dict[tuple, Codec] = {}  # of this Python worker


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Codec:
    """The tree reduction over a tiktoken encoding without special tokens."""

    def __init__(self, data: bytes, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        ranks = read_ranks(data)
        self.leaf, self.window = max(1, leaf), max(1, window)
        self.encoding = tiktoken.Encoding("sylva", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_ordinary(text) if len(text) < 64 else self.encoding.encode_to_numpy(text, disallowed_special=()), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        return self._tree(text, 0, len(text)) if text else np.zeros(0, np.uint32)

    def _tree(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return self.ids(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        w, a, i = self.window, lo, 0
        while True:
            at = max(lo, mid - w)
            last = None
            for last in _CUT.finditer(text, at, mid):
                pass
            if last is not None:
                a = last.start() + 1
                i = len(left) - self.covering(left[::-1], len(text[a:mid].encode()))
                break
            if at == lo:
                break
            w *= 4
        w, b, j = self.window, hi, len(right)
        while True:
            to = min(hi, mid + w)
            if found := _CUT.search(text, mid, to):
                b = found.start() + 1
                j = self.covering(right, len(text[mid:b].encode()))
                break
            if to == hi:
                break
            w *= 4
        return np.concatenate([left[:i], self.ids(text[a:b]), right[j:]])

    def covering(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many of the first ids make up exactly n_bytes."""
        total = np.cumsum(self.sizes[ids[:n_bytes]])  # a token has one byte at least
        k = int(np.searchsorted(total, n_bytes))
        if k >= len(total) or total[k] != n_bytes:
            raise ValueError("a token reaches over a cut: the pattern isn't one that this join is proven for")
        return k + 1

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.pieces.__getitem__, ids.tolist()))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def codec(data: bytes, pattern: str, leaf: int, window: int) -> Codec:
    key = (hash(data), pattern, leaf, window)
    if key not in _codecs:
        _codecs[key] = Codec(data, pattern, leaf, window)
    return _codecs[key]


def encode_decode(docs: DataFrame, path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (bytes), one row per document."""
    with open(path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        c = codec(shipped.value, pattern, leaf, window)

        def step(batch):
            rows = texts(batch) if batch is not None else []
            doc_ids = batch.column("doc_id") if batch is not None else None
            for at in range(0, len(rows), 64):
                ids = [c.encode(x) for x in rows[at : at + 64]]
                yield {"doc_id": doc_ids[at : at + 64], "n_tokens": [len(x) for x in ids], "ids": [x.astype("<u4").tobytes() for x in ids], "decoded": [c.decode(x) for x in ids]}

        return step

    return map_batches(only(docs, "doc_id", "text"), make, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    return digests(out)


def digests(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


SQL = None  # merges can't be said in SQL; tests hold the query against the library and the exact round trip
