"""Repeated byte strings removed: suffixes range-partitioned by sampled splitters, sorted in buckets, compared across borders.

A suffix counts by its first SPAN bytes (200): it is repeated if another one, anywhere, begins with the same bytes. Its
leading token is the ANCHOR bytes (50) with the least hash of all such strings within the SPAN, which are the same for
equal suffixes, and at the same place in them. Suffixes of one text that follow each other mostly have the same leading
token, so they are one row: the token, and the text from the first suffix to the end of the last one.

1. Texts that are equal byte by byte (SHA-256) stand for one; with copies they are removed whole.
2. Leading tokens are counted by their hash. A suffix whose leading token leads at no other place can't be repeated; a
   text gets the list of those of its tokens that are repeated. (A collision of hashes only keeps more suffixes.)
3. Rows are range-partitioned by (token, bytes, text) with Spark's sampled splitters and sorted. A bucket is taken in pieces of
   bounded size. In a piece, equal rows collapse, the others' suffixes are sorted by multikey quicksort (eight bytes a
   key, all groups at once; a suffix that is alone in its group is done).
4. The first and the last token of a piece may go on in the next one, or in another bucket: their suffixes' digests (128
   bits, one for each different suffix of a piece) meet in a join, so that a token of any number of rows is split.
5. The suffixes of a row that are repeated cover one stretch, as all of them hold the token. The stretches of a text are
   merged and cut out.

Defined results: null text counts as empty, texts of less than SPAN bytes stay whole; null doc_ids are kept; rows that
repeat another are copies of it; an empty table gives an empty table; other columns are ignored. A text is read in
segments, so that arrays don't grow with it; a string that repeats within its text is told at once and is one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import drop_table, map_batches, materialise, only, table
from sylva.llm.wordhash import mix

SPAN, ANCHOR = 200, 50
#: Bytes of a segment (its places must fit PLACE_BITS), bytes of rows of a piece, rows of a bucket.
SEGMENT, PLACE_BITS, PIECE, BUCKET_ROWS = 1 << 18, 20, 4 << 20, 50_000

_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each place on: polynomials of 1, 2, 4 ... bytes, put together."""
    part, size, out, done = _BYTES[raw], 1, None, 0
    while True:
        if k & size:
            if out is None:
                out = part
            else:
                n = len(raw) - done - size + 1
                out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + part[done : done + n]
            done += size
        if done == k:
            return mix(out)
        n = len(part) - size
        part = part[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of the width values from each place on."""
    n, size = len(v) - width + 1, 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:n], v[width - size : width - size + n])


def segments(rows: list[bytes], span: int, size: int = SEGMENT) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, place in it, bytes) of about size bytes: several rows, or a stretch of a long one (they overlap)."""
    held, n = [], 0
    for i, x in enumerate(rows):
        for at in range(0, max(len(x) - span + 1, 0), size):
            part = x[at : at + size + span - 1]
            if held and n + len(part) > size:
                yield held
                held, n = [], 0
            held.append((i, at, part))
            n += len(part)
    if held:
        yield held


class Segment:
    """The suffixes of some stretches of text: `start` (place in raw), `part` (which stretch) and `token` (place of the leading token)."""

    def __init__(self, parts: list[tuple[int, int, bytes]], span: int, anchor: int):
        self.bytes = b"".join(x for _, _, x in parts)
        raw = np.frombuffer(self.bytes, np.uint8)
        sizes = np.array([len(x) for _, _, x in parts], np.int64)
        self.offsets = np.cumsum(sizes) - sizes
        self.rows = np.array([i for i, _, _ in parts], np.int64)
        self.hashes = gram_hashes(raw, anchor)
        places = np.uint64((1 << PLACE_BITS) - 1)
        least = sliding_min(self.hashes & ~places | np.arange(len(self.hashes), dtype=np.uint64), span - anchor + 1)
        counts = sizes - span + 1
        self.part = np.repeat(np.arange(len(parts)), counts)
        self.start = np.arange(counts.sum()) + np.repeat(self.offsets - (np.cumsum(counts) - counts), counts)
        self.token = (least[self.start] & places).astype(np.int64)

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """part and hash of each leading token, once a stretch, and each suffix's number among them."""
        new = np.append(True, (self.token[1:] != self.token[:-1]) | (self.part[1:] != self.part[:-1]))
        return self.part[new], self.hashes[self.token[new]], np.cumsum(new) - 1


def leading_tokens(texts: DataFrame, span: int, anchor: int) -> DataFrame:
    """h, key, n: how often each leading token's hash is in each text."""

    def make():
        def step(batch):
            if batch is None:
                return
            keys = batch.column("key").to_numpy()
            for parts in segments(batch.column("text").to_pylist(), span):
                s = Segment(parts, span, anchor)
                part, h, _ = s.tokens()
                row = s.rows[part]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
                yield {"h": h[first].view(np.int64), "key": keys[row[first]], "n": np.diff(np.append(first, len(h)))}

        return step

    return map_batches(texts, make, "h bigint, key bigint, n int")


ROWS = "token binary, body binary, before int, id binary, at bigint, stop bigint"


def candidate_rows(texts: DataFrame, span: int, anchor: int) -> DataFrame:
    """Rows of suffixes whose leading token is repeated: token, body (from the first suffix, at `at`, to the last one's end) and before (bytes of body before the token).

    texts: id, text, hs (the hashes of its tokens that are repeated). A row that a text has twice is given once, and its
    places as stretches that are repeated (without token: at, stop).
    """
    names = [x.split()[0] for x in ROWS.split(", ")]

    def make():
        def step(batch):
            if batch is None:
                return
            ids, repeated = batch.column("id").to_pylist(), batch.column("hs")
            seen: dict[bytes, int] = {}
            of = -1
            for parts in segments(batch.column("text").to_pylist(), span):
                s = Segment(parts, span, anchor)
                known = [repeated[int(i)].values.to_numpy().view(np.uint64) for i in s.rows]
                part, h, of_token = s.tokens()
                salt = mix(np.arange(1, len(parts) + 1, dtype=np.uint64))
                keep = np.isin(mix(h ^ salt[part]), mix(np.concatenate(known) ^ np.repeat(salt, [len(x) for x in known])))[of_token]
                start, part, token = s.start[keep], s.part[keep], s.token[keep]
                if not len(start):
                    continue
                edge = np.flatnonzero((np.diff(start) != 1) | (np.diff(token) != 0) | (np.diff(part) != 0))
                lo, hi = np.append(0, edge + 1), np.append(edge, len(start) - 1)
                out: list[tuple] = []
                for x, y, t, p in zip(start[lo].tolist(), start[hi].tolist(), token[lo].tolist(), part[lo].tolist()):
                    row, from_ = parts[p][0], parts[p][1] - int(s.offsets[p])
                    if row != of:
                        seen, of = {}, row
                    body = s.bytes[x : y + span]
                    known_as = hashlib.blake2b(body, digest_size=16, salt=(t - x).to_bytes(4, "little")).digest()
                    before = seen.get(known_as)
                    if before is None:
                        seen[known_as] = x + from_
                        out.append((s.bytes[t : t + anchor], body, t - x, ids[row], x + from_, None))
                        continue
                    out.append((None, None, None, ids[row], x + from_, x + from_ + len(body)))
                    if before >= 0:
                        out.append((None, None, None, ids[row], before, before + len(body)))
                        seen[known_as] = -1
                if out:
                    yield dict(zip(names, map(list, zip(*out))))

        return step

    return map_batches(texts, make, ROWS)


def multikey_sort(words: np.ndarray, start: np.ndarray, group: np.ndarray, places: list[int]) -> np.ndarray:
    """Which suffixes have an equal one in their group: words[i] are the eight bytes from place i on, in their order.

    Multikey quicksort, a key a round: each group is sorted by the next word and falls apart; those alone are done.
    """
    at = np.argsort(group, kind="stable")
    group = group[at]
    at, group = shared(at, group)
    for place in places:
        if not len(at):
            break
        word = words[start[at] + place]
        order = np.lexsort((word, group))
        at, group, word = at[order], group[order], word[order]
        new = np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1]))
        at, group = shared(at, np.cumsum(new))
    same = np.zeros(len(start), bool)
    same[at] = True
    return same


def shared(at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the groups of one."""
    if not len(at):
        return at, group
    new = np.append(True, group[1:] != group[:-1])
    more = ~(new & np.append(new[1:], True))
    return at[more], group[more]


def big_endian_words(raw: bytes) -> np.ndarray:
    """The eight bytes from each place on, as numbers in the order of the bytes."""
    n = len(raw) - 7
    out = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        out[k::8] = np.frombuffer(raw, ">u8", (n - k + 7) // 8, k)
    return out


FOUND = "id binary, at bigint, stop bigint, digest binary"


def piece(rows: list[tuple], span: int) -> list[tuple]:
    """Of sorted rows (token, body, before, id, at): stretches (id, at, stop, None), and suffixes of the first and last token (id or None if it is repeated, at, stop, digest)."""
    out: list[tuple] = []
    distinct: list[tuple] = []
    twice: list[bool] = []
    for row in rows:
        if distinct and row[1] == distinct[-1][1] and row[2] == distinct[-1][2] and row[0] == distinct[-1][0]:
            if not twice[-1]:
                _, body, _, id_, at = distinct[-1]
                out.append((id_, at, at + len(body), None))
            twice[-1] = True
            out.append((row[3], row[4], row[4] + len(row[1]), None))
        else:
            distinct.append(row)
            twice.append(False)
    tokens = np.cumsum([i == 0 or x[0] != distinct[i - 1][0] for i, x in enumerate(distinct)])
    raw = b"".join(x[1] for x in distinct)
    sizes = np.array([len(x[1]) for x in distinct], np.int64)
    counts, offsets = sizes - span + 1, np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(distinct)), counts)
    t = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[row] + t
    # equal suffixes have their token at the same place
    group = tokens[row] * span + np.array([x[2] for x in distinct], np.int64)[row] - t
    places = [*range(0, span - 7, 8)] + ([span - 8] if span % 8 else [])
    same = multikey_sort(big_endian_words(raw), start, group, places)
    hits = np.flatnonzero(same)
    if len(hits):
        first = np.flatnonzero(np.append(True, np.diff(row[hits]) != 0))
        last = np.append(first[1:], len(hits)) - 1
        for r, x, y in zip(row[hits[first]].tolist(), t[hits[first]].tolist(), t[hits[last]].tolist()):
            _, _, _, id_, at = distinct[r]
            out.append((id_, at + x, at + y + span, None))
    same |= np.array(twice)[row]
    border = np.flatnonzero((tokens[row] == tokens[0]) | (tokens[row] == tokens[-1]))
    said: set[bytes] = set()
    for i in border.tolist():
        digest = hashlib.blake2b(raw[start[i] : start[i] + span], digest_size=16).digest()
        if same[i]:
            if digest in said:
                continue
            said.add(digest)
            out.append((None, None, None, digest))
        else:
            _, _, _, id_, at = distinct[row[i]]
            at += int(t[i])
            out.append((id_, at, at + span, digest))
    return out


def bucket_pieces(rows: DataFrame, buckets: int, span: int, size: int) -> DataFrame:
    """What the pieces of the range-sorted buckets give (see piece)."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def make():
        held: list[tuple] = []
        n = [0]

        def ended() -> Iterator[dict]:
            if held:
                found = piece(held, span)
                held.clear()
                n[0] = 0
                for at in range(0, len(found), 8192):
                    yield dict(zip(names, map(list, zip(*found[at : at + 8192]))))

        def step(batch):
            if batch is None:
                yield from ended()
                return
            for row in zip(*(batch.column(c).to_pylist() for c in ("token", "body", "before", "id", "at"))):
                held.append(row)
                n[0] += len(row[1])
                if n[0] >= size:
                    yield from ended()

        return step

    return map_batches(rows.repartitionByRange(buckets, "token", "body", "id").sortWithinPartitions("token", "body", "before"), make, FOUND)


def distinct_texts(docs: DataFrame, span: int) -> DataFrame:
    """id, key, text: each different text of span bytes or more once; a task sends a text that it has several times once."""
    rows = docs.where(F.octet_length("text") >= span).select(F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("id"), F.col("text").cast("binary").alias("text"))

    def once():
        seen: set[bytes] = set()

        def step(batch):
            if batch is None:
                return
            at = []
            for i, x in enumerate(batch.column("id").to_pylist()):
                if x not in seen:
                    seen.add(x)
                    at.append(i)
            if at:
                part = batch.take(at) if len(at) < batch.num_rows else batch
                yield {"id": part.column("id"), "text": part.column("text")}

        return step

    schema = "id binary, text binary"
    sent = map_batches(rows, once, schema)
    return map_batches(sent.repartition("id"), once, schema).select("id", F.xxhash64("id").alias("key"), "text")


def cut_out(texts: DataFrame) -> DataFrame:
    """id, n_removed, n_spans, kept_sha256 from id, text and stretches (at, stop)."""

    def make():
        def step(batch):
            if batch is None:
                return
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                removed, spans, kept = [], [], []
                for text, stretches in zip(part.column("text").to_pylist(), part.column("stretches").to_pylist()):
                    text, to, n, left, sha = memoryview(text), 0, 0, 0, hashlib.sha256()
                    for x, y in sorted((s["at"], s["stop"]) for s in stretches):
                        if x > to or not n:
                            sha.update(text[to:x])
                            left += x - to
                            n += 1
                        to = max(to, y)
                    sha.update(text[to:])
                    removed.append(to - left)
                    spans.append(n)
                    kept.append(sha.hexdigest())
                yield {"id": part.column("id"), "n_removed": removed, "n_spans": spans, "kept_sha256": kept}

        return step

    return map_batches(texts, make, "id binary, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, size: int = PIECE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = only(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    texts = materialise(distinct_texts(docs, span), "distinct-texts")
    tokens = materialise(leading_tokens(texts, span, anchor), "leading-tokens")
    often = tokens.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    repeated = materialise(tokens.join(often, "h", "left_semi").groupBy("key").agg(F.collect_list("h").alias("hs")), "repeated-tokens")
    drop_table(tokens)
    rows = materialise(candidate_rows(texts.join(repeated.hint("shuffle_hash"), "key"), span, anchor), "suffix-rows")
    drop_table(repeated)
    sorted_rows = rows.where("token is not null")
    n, least = sorted_rows.count(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    found = materialise(bucket_pieces(sorted_rows, max(1, -(-n // bucket_rows), min(least, n // 2_000)), span, size), "suffix-pieces")
    border = found.where("digest is not null")
    again = border.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    across = border.where("id is not null").join(again, "digest", "left_semi")
    stretches = [x.select("id", F.struct("at", "stop").alias("s")) for x in (rows.where("token is null"), found.where("digest is null"), across)]
    stretches = stretches[0].union(stretches[1]).union(stretches[2]).groupBy("id").agg(F.collect_list("s").alias("stretches"))
    cut = materialise(cut_out(texts.join(stretches.hint("shuffle_hash"), "id")), "texts-cut")
    for x in (texts, rows, found):
        drop_table(x)
    sha = F.sha2("text", 256)
    own = docs.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), sha.alias("sha"), F.unhex(F.substring(sha, 1, 32)).alias("id"))
    copies = own.where(F.col("n_bytes") >= span).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    verdicts = cut.join(copies, "id", "left_anti").withColumn("copy", F.lit(False))
    whole = copies.select("id", F.lit(None).cast("bigint").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit(True).alias("copy"))
    none = F.lit(0).cast("bigint")
    removed = F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed")
    out = own.join(verdicts.union(whole), "id", "left")
    return out.select("doc_id", "n_bytes", removed, F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Every 200 bytes by their MD5; a span begins where the repeated string before starts more than 200 bytes earlier.
SQL = """
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT r, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM docs)),
again AS (SELECT r, i FROM starts WHERE k IN (SELECT k FROM starts GROUP BY k HAVING count(*) > 1)),
marks AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM again),
spans AS (SELECT r, g, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM marks) GROUP BY r, g),
pieces AS (
    SELECT r, g, substr(x, 2 * b + 1, 2 * (coalesce(lead(a) OVER (PARTITION BY r ORDER BY g), length(x) // 2) - b)) AS piece FROM spans JOIN docs USING (r)
    UNION ALL SELECT r, 0, substr(x, 1, 2 * min(a)) FROM spans JOIN docs USING (r) GROUP BY r, x),
kept AS (SELECT r, string_agg(piece, '' ORDER BY g) AS piece FROM pieces GROUP BY r),
sums AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(piece, x))) AS kept_sha256
FROM docs LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""
