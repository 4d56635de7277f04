"""Token counts by a map-side two-tier lookup.

The tokenizer drops white space before it cuts a text, so the runs between white space are counted one by one and
added: no token reaches over a blank. The first tier is a broadcast hash table with the token counts of the most
frequent runs (at most TABLE_ROWS of at most KEY_CHARS characters: its size is bounded). The second is a cache that each
Python worker keeps over its tasks (at most CACHE_ROWS); what neither has is encoded in batches by the library and
cached. Texts and runs are never shuffled: the table comes from summaries of at most SUMMARY_ROWS heavy runs a task.
The table only saves time; any table gives the same counts.

Defined results: null text counts as empty (0 bytes, 0 tokens, not over the limit); null doc_ids are kept; repeated rows
are counted each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import map_batches, only, table, texts

TABLE_ROWS, KEY_CHARS, SUMMARY_ROWS, COUNTER_ROWS, CACHE_ROWS = 16_384, 48, 1_024, 150_000, 400_000
TOKEN_LIMIT = 2048
TOKENIZER = "word_bpe_49k.json"

_workers: dict[int, tuple] = {}  # of this Python worker: by the tokenizer's hash, the tokenizer and its cache

#: Python splits at these as well; for the tokenizer they aren't white space.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")


def runs(text: str) -> list[str]:
    """The runs between white space, as the tokenizer sees it."""
    if _ODD.search(text):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


def load_tokenizer(data: bytes):
    """The tokenizer from the file's bytes, and this worker's cache for it."""
    key = hash(data)
    if key not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(data.decode())
        tok.no_truncation()
        tok.no_padding()
        _workers[key] = (tok, {})
    return _workers[key]


def lengths(tok, keys: list[str]) -> list[int]:
    return [len(x.ids) for x in tok.encode_batch(keys, add_special_tokens=False)]


def frequent_runs(docs: DataFrame, rows: int = TABLE_ROWS) -> list[str]:
    """The most frequent runs over all texts: each task sums up its texts in a bounded counter, and summaries are added."""

    def make():
        seen: Counter[str] = Counter()
        floor = [0]

        def step(batch):
            if batch is not None:
                for text in texts(batch):
                    seen.update(runs(text))
                    if len(seen) > COUNTER_ROWS:  # lossy counting: the rare ones go until there is room
                        while len(seen) > COUNTER_ROWS // 2:
                            floor[0] += 1
                            for k in [k for k, n in seen.items() if n <= floor[0]]:
                                del seen[k]
                return
            top = [(k, n) for k, n in seen.most_common(2 * SUMMARY_ROWS) if len(k) <= KEY_CHARS][:SUMMARY_ROWS]
            yield {"run": [k for k, _ in top], "n": [n for _, n in top]}

        return step

    found = map_batches(only(docs, "text"), make, "run string, n bigint").groupBy("run").agg(F.sum("n").alias("n"))
    return [r[0] for r in found.orderBy(F.desc("n"), "run").limit(rows).collect()]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = TOKEN_LIMIT, rows: int = TABLE_ROWS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    sc = docs.sparkSession.sparkContext
    keys = frequent_runs(docs, rows)
    tier = sc.broadcast(dict(zip(keys, lengths(load_tokenizer(data)[0], keys))))
    model = sc.broadcast(data)

    def make():
        first = tier.value
        tok, cache = load_tokenizer(model.value)

        def step(batch):
            if batch is None or not batch.num_rows:
                return
            parts = [(x, runs(x)) for x in texts(batch)]
            missing = {r for _, p in parts for r in p if r not in first and r not in cache}
            if missing:
                if len(cache) + len(missing) > CACHE_ROWS:
                    cache.clear()
                    missing = {r for _, p in parts for r in p if r not in first}
                new = list(missing)
                for at in range(0, len(new), 4096):
                    cache.update(zip(new[at : at + 4096], lengths(tok, new[at : at + 4096])))
            known = [sum(first[r] if r in first else cache[r] for r in p) for _, p in parts]
            for r in missing:
                if len(r) > 4 * KEY_CHARS:  # long runs aren't worth the room
                    del cache[r]
            yield {"doc_id": batch.column("doc_id"), "n_bytes": [len(x.encode()) for x, _ in parts], "n_tokens": known}

        return step

    out = map_batches(only(docs, "doc_id", "text"), make, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


SQL = None  # a tokenizer's merges can't be said in SQL; tests hold the query against the library on whole texts
