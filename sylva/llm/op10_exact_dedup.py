"""Exact dedup by a log-structured merge index.

Every map task keeps a memtable from SHA-256 digest to the smallest doc_id, the members and the text. A second row with
a digest that the memtable holds is a hit, verified byte by byte. A full memtable is flushed as a sorted run of digests,
rows of level 0 in the shared folder. Compaction deals level 0 by ranges of digests, and each range merges its sorted
rows in one stream into one run of level 1, which keeps the smallest identifier of a digest. Only digests that two runs
have go on: those that one run has are done, as the memtable verified them. Each segment of level 1 has a filter sized by
its entries; as segments are sorted and apart, a digest is looked up in one filter only. The filters pick the rows of
level 0 that need level 1's identifier, and in a second scan the texts to compare byte by byte, one a run (smallest
against largest text, which a partial aggregation finds without gathering a group). Where texts of one digest differ,
that digest's rows are grouped by their whole texts instead, so a collision never merges different texts.

Filters are shipped in passes of FILTER_BYTES, each for a range of digests with a scan of its own, so no filter gets
fuller as the corpus grows. A hot group never meets in one task: a run holds it as one row, members go on as the run's own
arrays, and the digests with a thousandth of level 0 or more, of which there can be a thousand, meet it by broadcast.

Defined results: null text counts as empty; null doc_ids are kept, and are never the smallest unless all are null;
repeated rows with one doc_id count each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import BLANK, byte_texts, fresh, map_batches, materialise, normal_bytes, only, table

#: A memtable is flushed when it holds so many bytes of text, or so many rows.
MEMTABLE_BYTES, MEMTABLE_ROWS = 48 << 20, 200_000
#: Entries of a segment of level 1; bits an entry and hash functions of its filter; bytes of filters that are shipped at once.
SEGMENT, ENTRY_BITS, FILTER_HASHES, FILTER_BYTES = 1 << 18, 12, 4, 64 << 20
#: A digest is hot with this part of level 0's rows, and no fewer than so many.
HOT_PART, HOT_ROWS = 1000, 64

RUN = "run string, digest binary, keep_id bigint, n bigint, ids array<bigint>, clash boolean"
#: Hits (bits null) and filters (digest and last: the segment's range).
LEVEL = "digest binary, keep_id bigint, group_size bigint, runs bigint, clash boolean, last binary, bits binary"


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


class Memtable:
    """Digest -> [text, ids, clash]; bounded in bytes and rows."""

    def __init__(self, max_bytes: int = MEMTABLE_BYTES, max_rows: int = MEMTABLE_ROWS):
        self.max_bytes, self.max_rows = max_bytes, max_rows
        self.clear()

    def clear(self) -> None:
        self.entries: dict[bytes, list] = {}
        self.bytes = self.rows = 0

    def put(self, digest: bytes, doc_id: int | None, text: bytes) -> bool:
        """True if the table is full."""
        entry = self.entries.get(digest)
        if entry is None:
            self.entries[digest] = [text, [doc_id], False]
            self.bytes += len(text)
        else:
            entry[2] |= entry[0] != text  # byte verification of a hit
            entry[1].append(doc_id)
        self.rows += 1
        return self.bytes >= self.max_bytes or self.rows >= self.max_rows

    def sorted(self) -> list[tuple[bytes, list]]:
        return sorted(self.entries.items(), key=lambda x: x[0])


def hashes(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes a digest, from which a filter of any size derives its positions."""
    parts = np.frombuffer(b"".join(hashlib.blake2b(d, digest_size=16).digest() for d in digests), "<u8").reshape(-1, 2)
    return parts[:, :1], parts[:, 1:] | np.uint64(1)


def positions(digests: list[bytes], bits: np.ndarray | int) -> np.ndarray:
    """FILTER_HASHES positions a digest, in a filter of so many bits (one size, or one a digest)."""
    a, b = hashes(digests)
    size = np.asarray(bits, np.uint64).reshape(-1, 1)
    return ((a + np.arange(FILTER_HASHES, dtype=np.uint64) * b) % size).astype(np.int64)


def segment_filter(digests: list[bytes]) -> bytes:
    n = -(-ENTRY_BITS * len(digests) // 64) * 64
    bits = np.zeros(n, bool)
    bits[positions(digests, n).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Filters:
    """The filters of segments that are sorted and apart."""

    def __init__(self, segments: list[tuple[bytes, bytes, bytes]]):
        segments = sorted(segments)
        self.first, self.last = [s[0] for s in segments], [s[1] for s in segments]
        self.sizes = np.array([8 * len(s[2]) for s in segments], np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.words = np.frombuffer(b"".join(s[2] for s in segments), "<u8")

    def may_hold(self, digests: list[bytes]) -> np.ndarray:
        at = np.array([bisect_right(self.first, d) - 1 for d in digests], np.int64)
        within = np.array([i >= 0 and d <= self.last[i] for i, d in zip(at, digests)], bool)
        some = np.flatnonzero(within)
        if not len(some):
            return within
        at = at[some]
        bit = positions([digests[i] for i in some], self.sizes[at]) + self.starts[at][:, None]
        within[some] = ((self.words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
        return within


def flush_runs(docs: DataFrame, digest: Callable[[bytes], bytes], max_bytes: int, max_rows: int) -> DataFrame:
    def make():
        import uuid

        mem = Memtable(max_bytes, max_rows)

        def flush():
            rows = mem.sorted()
            run = uuid.uuid4().hex
            mem.clear()
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                known = [[i for i in e[1] if i is not None] for _, e in part]
                yield {"run": [run] * len(part), "digest": [d for d, _ in part], "keep_id": [min(k, default=None) for k in known], "n": [len(e[1]) for _, e in part], "ids": [e[1] for _, e in part], "clash": [e[2] for _, e in part]}

        def step(batch):
            if batch is None:
                yield from flush()
                return
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), byte_texts(batch)):
                text = normal_bytes(raw)
                if mem.put(digest(text), doc_id, text):
                    yield from flush()

        return step

    return map_batches(only(docs, "doc_id", "text"), make, RUN)


def compact(runs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Level 1 (see LEVEL): digests of two rows of level 0 or more and those with a clash, and the filters over them.

    A range's rows come sorted, so equal digests follow one another and one entry is held at a time.
    """

    def make():
        entry: list = []  # digest, keep_id, group_size, runs, clash
        done: list[list] = []

        def close():
            if entry and (entry[3] > 1 or entry[4]):
                done.append(list(entry))

        def flush():
            if not done:
                return
            digests, none = [e[0] for e in done], [None] * len(done)
            cols = zip(*done)
            yield dict(zip(("digest", "keep_id", "group_size", "runs", "clash"), map(list, cols))) | {"last": none, "bits": none}
            one = {"digest": digests[:1], "last": digests[-1:], "bits": [segment_filter(digests)]}
            done.clear()
            yield {"keep_id": [None], "group_size": [None], "runs": [None], "clash": [None]} | one

        def step(batch):
            if batch is None:
                close()
                yield from flush()
                return
            for digest, keep_id, n, clash in zip(*[batch.column(c).to_pylist() for c in ("digest", "keep_id", "n", "clash")]):
                if entry and entry[0] == digest:
                    if keep_id is not None:
                        entry[1] = keep_id if entry[1] is None else min(entry[1], keep_id)
                    entry[2], entry[3], entry[4] = entry[2] + n, entry[3] + 1, entry[4] or clash
                    continue
                close()
                entry[:] = [digest, keep_id, n, 1, clash]
                if len(done) >= segment:
                    yield from flush()

        return step

    level0 = runs.select("digest", "keep_id", "n", "clash").repartitionByRange("digest").sortWithinPartitions("digest")
    return map_batches(level0, make, LEVEL)


def passes(filters: DataFrame, most: int) -> list[tuple[bytes | None, bytes | None]]:
    """Ranges of digests (from, to before; null: no end) whose filters have at most so many bytes (or are one filter).

    The driver sees a digest and a size for each filter, which stands for SEGMENT repeated digests.
    """
    starts, size = [], most
    for digest, n in sorted((bytes(r["digest"]), r["n"]) for r in filters.select("digest", F.length("bits").alias("n")).collect()):
        if size + n > most:
            starts.append(digest)
            size = 0
        size += n
    return list(zip([None, *starts[1:]], [*starts[1:], None])) if starts else []


def in_range(df: DataFrame, low: bytes | None, high: bytes | None) -> DataFrame:
    df = df.where(F.col("digest") >= F.lit(bytearray(low))) if low is not None else df
    return df.where(F.col("digest") < F.lit(bytearray(high))) if high is not None else df


def ship(filters: DataFrame, low: bytes | None, high: bytes | None):
    """The filters of a range, as a broadcast of at most FILTER_BYTES and their ranges."""
    rows = in_range(filters, low, high).select("digest", "last", "bits").collect()
    return filters.sparkSession.sparkContext.broadcast(Filters([(bytes(r["digest"]), bytes(r["last"]), bytes(r["bits"])) for r in rows]))


def mark(runs: DataFrame, shipped) -> DataFrame:
    """Rows of level 0 with `maybe`: level 1 may have their digest."""

    def make():
        def step(batch):
            if batch is not None and batch.num_rows:
                yield {c: batch.column(c) for c in ("digest", "keep_id", "n", "ids")} | {"maybe": shipped.value.may_hold(batch.column("digest").to_pylist())}

        return step

    return map_batches(runs.select("digest", "keep_id", "n", "ids"), make, "digest binary, keep_id bigint, n bigint, ids array<bigint>, maybe boolean")


def with_groups(marked: DataFrame, hits: DataFrame, hot: DataFrame | None) -> DataFrame:
    """digest, ids, keep_id, group_size of marked rows: level 1's where it has the digest, else their own."""
    entry = hits.select("digest", F.col("keep_id").alias("least"), "group_size")
    own = marked.where("not maybe").select("digest", "ids", "keep_id", F.col("n").alias("group_size"))
    some, parts = marked.where("maybe"), [own]
    if hot is not None:
        names = F.broadcast(hot.select("digest"))
        parts.append(some.join(F.broadcast(entry.join(names, "digest", "left_semi")), "digest").select("digest", "ids", F.col("least").alias("keep_id"), "group_size"))
        some, entry = some.join(names, "digest", "left_anti"), entry.join(names, "digest", "left_anti")
    found = F.col("group_size").isNotNull()
    joined = some.join(entry, "digest", "left")
    parts.append(joined.select("digest", "ids", F.when(found, F.col("least")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", "n").alias("group_size")))
    return reduce(DataFrame.unionByName, parts)


def candidate_texts(docs: DataFrame, shipped, digest: Callable[[bytes], bytes], max_bytes: int, max_rows: int) -> DataFrame:
    """(digest, text) of rows that pass the filters, one for each digest and memtable."""

    def make():
        mem = Memtable(max_bytes, max_rows)

        def flush():
            rows = mem.sorted()
            mem.clear()
            for at in range(0, len(rows), 256):
                yield {"digest": [d for d, _ in rows[at : at + 256]], "text": [e[0] for _, e in rows[at : at + 256]]}

        def step(batch):
            if batch is None:
                yield from flush()
                return
            if not batch.num_rows:
                return
            normal = [normal_bytes(x) for x in byte_texts(batch)]
            digests = [digest(x) for x in normal]
            for i in np.flatnonzero(shipped.value.may_hold(digests)):
                if mem.put(digests[i], None, normal[i]):
                    yield from flush()

        return step

    return map_batches(only(docs, "text"), make, "digest binary, text binary")


def split_clashes(docs: DataFrame, clashes: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """Rows of digests with different texts, grouped by their whole texts."""

    def make():
        def step(batch):
            if batch is not None:
                normal = [normal_bytes(x) for x in byte_texts(batch)]
                yield {"doc_id": batch.column("doc_id"), "digest": [digest(x) for x in normal], "text": normal}

        return step

    rows = map_batches(only(docs, "doc_id", "text"), make, "doc_id bigint, digest binary, text binary").join(clashes, "digest", "left_semi")
    groups = rows.groupBy("text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return rows.join(groups, "text").select("doc_id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"))


def exact_dedup(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256, max_bytes: int = MEMTABLE_BYTES, max_rows: int = MEMTABLE_ROWS, segment: int = SEGMENT, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    runs = materialise(flush_runs(docs, digest, max_bytes, max_rows), "runs")
    level1 = materialise(compact(runs, segment), "level1")
    hits, filters = level1.where("bits is null"), level1.where("bits is not null")
    hot = hits.where(F.col("runs") >= max(HOT_ROWS, runs.count() // HOT_PART)).select("digest")
    hot = hot if hot.take(1) else None
    parts, unequal = [], [hits.where("clash").select("digest")]
    for low, high in passes(filters, filter_bytes):
        shipped = ship(filters, low, high)
        parts.append(with_groups(mark(in_range(runs, low, high), shipped), in_range(hits, low, high), hot))
        found = candidate_texts(docs, shipped, digest, max_bytes, max_rows).groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
        unequal.append(found.where("a != b").select("digest"))
    own = runs.select("digest", "ids", "keep_id", F.col("n").alias("group_size"))
    rows = reduce(DataFrame.unionByName, parts) if parts else own
    clashes = materialise(reduce(DataFrame.unionByName, unequal).distinct(), "clashes")
    split = None
    if clashes.take(1):
        rows = rows.join(clashes, "digest", "left_anti")
        split = split_clashes(docs, clashes, digest)
    if digest is sha256:
        rows = rows.withColumn("text_sha256", F.lower(F.hex("digest")))
    else:  # another digest is for tests: the texts' own SHA-256 isn't in the index
        rows = rows.withColumn("text_sha256", F.lit(None).cast("string"))
    out = rows.select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "text_sha256")
    out = out.unionByName(split) if split is not None else out
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the copies: of equal texts the row with the smallest doc_id stays (one of them, if it is repeated).

    Rows are known by doc_id and digest, so a doc_id on rows with different texts doesn't keep a text that another row has.
    """
    row_id, sha, times, own = (fresh(docs, x) for x in ("row_id", "kept_sha", "times", "own_sha"))
    kept = exact_dedup(docs).where("kept").groupBy(F.col("doc_id").alias(row_id), F.col("text_sha256").alias(sha)).agg(F.count("*").alias(times))
    kept = materialise(kept, "kept")
    rows = docs.withColumn(own, F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), BLANK, " "), 256))
    same = F.col(own).eqNullSafe(F.col(sha)) & docs["doc_id"].eqNullSafe(F.col(row_id))
    if not kept.where(F.col(times) > 1).take(1):
        return rows.join(kept, same, "left_semi").drop(own)
    once = rows.join(kept.where(F.col(times) == 1), same, "left_semi")
    again = rows.join(kept.where(F.col(times) > 1), same, "left_semi").dropDuplicates(["doc_id", own])
    return once.unionByName(again).drop(own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
     g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.x) AS text_sha256
FROM t JOIN g ON t.x = g.x
"""
