"""Sharding by extendible hashing.

A document's key is the first 48 bits of md5(doc_id). The directory is indexed by key prefixes: a bucket of local depth d
holds all keys with one d-bit prefix; if its texts exceed the byte limit, it alone is split on the next bit. Sums never
grow with the depth, so a key's bucket is the shallowest of its prefixes that fits. One aggregation gives the bytes of
all prefixes of `depth` bits, whose ancestors' sums give the directory; prefixes that are still too large are refined by
STEP bits more, over their rows only, until all fit. A bucket of one key only (a single document, or rows with one
doc_id) can't be split by any bit and may exceed the limit; it is a shard of its own, marked `oversize`.

Defined results: null text has 0 bytes; a null doc_id hashes as the empty string; repeated rows go to one shard; an empty
table gives an empty table; other columns are ignored (write_shards keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import fresh, materialise, table

KEY_BITS, STEP, SHARD_BYTES = 48, 8, 8 << 20


def keyed(docs: DataFrame) -> DataFrame:
    key = F.conv(F.substring(F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("bigint")
    return docs.select("doc_id", key.alias("key"), F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("bigint").alias("n_bytes"))


def prefix(depth: int | str):
    return F.expr(f"shiftright(key, {KEY_BITS} - {depth})")


def level(rows: DataFrame, from_depth: int, to_depth: int, limit: int) -> DataFrame:
    """For each prefix of to_depth bits: its bucket (depth, prefix, bytes, docs, oversize), or null depth if none of its prefixes fits."""
    cells = rows.groupBy(prefix(to_depth).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    up = cells.select("*", F.explode(F.sequence(F.lit(from_depth), F.lit(to_depth))).alias("depth"))
    up = up.withColumn("bucket", F.expr(f"shiftright(cell, {to_depth} - depth)"))
    sums = up.groupBy("depth", "bucket").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fits = sums.where((F.col("b") <= limit) | (F.col("lo") == F.col("hi"))).withColumn("oversize", F.col("b") > limit)
    # a bucket is in the directory if it fits and its parent doesn't (or there is none)
    parent = fits.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("bucket") * 2, F.col("bucket") * 2 + 1)).alias("bucket"))
    return fits.join(parent, ["depth", "bucket"], "left_anti").select("depth", "bucket", F.col("b").alias("shard_bytes"), F.col("n").alias("shard_docs"), "oversize")


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, shard (its prefix as bits), shard_bytes, shard_docs, oversize."""
    rows = materialise(keyed(docs), "keyed")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(KEY_BITS, max(4, math.ceil(math.log2(max(1, total / limit))) + 5))
    done: list[DataFrame] = []
    while True:
        directory = materialise(level(rows, low, high, limit), "directory")
        # every cell of `high` bits under a directory bucket points to it
        span = F.col("bucket").cast("bigint")
        cells = directory.withColumn("cell", F.explode(F.expr(f"sequence(shiftleft(bigint(bucket), {high} - depth), shiftleft(bigint(bucket) + 1, {high} - depth) - 1)")))
        own = rows.withColumn("cell", prefix(high))
        shard = F.when(F.col("depth") == 0, F.lit("-")).otherwise(F.lpad(F.bin(span), F.col("depth"), F.lit("0")))
        found = own.join(cells, "cell", "left")
        done.append(found.where("depth is not null").select("doc_id", "key", "n_bytes", shard.alias("shard"), "shard_bytes", "shard_docs", "oversize"))
        rest = found.where("depth is null").select(*rows.columns)
        if high == KEY_BITS or not rest.take(1):
            break
        rows, low, high = materialise(rest, "unsplit"), high + 1, min(KEY_BITS, high + STEP)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("key")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> str:
    """Writes docs as one folder a shard; gives the name of the folders' column (shard, if docs has none of that name)."""
    row_id, shard = fresh(docs, "row_id"), fresh(docs, "shard")
    ids = assign_shards(docs, limit).select(F.col("doc_id").alias(row_id), F.col("shard").alias(shard)).distinct()
    docs.join(ids, docs["doc_id"].eqNullSafe(ids[row_id])).drop(row_id).repartition(shard).write.partitionBy(shard).parquet(path)
    return shard


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS key, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
s AS (SELECT depth, key >> (48 - depth) AS bucket, sum(n_bytes) AS b, count(*) AS n, min(key) AS lo, max(key) AS hi
      FROM d, range(0, 49) r(depth) GROUP BY 1, 2),
f AS (SELECT * FROM s WHERE b <= 8388608 OR lo = hi),
k AS (SELECT x.key, min(f.depth) AS depth FROM (SELECT DISTINCT key FROM d) x JOIN f ON f.bucket = x.key >> (48 - f.depth) GROUP BY 1),
m AS (SELECT d.doc_id, d.key, d.n_bytes, k.depth FROM d JOIN k ON k.key = d.key)
SELECT m.doc_id, m.n_bytes, CASE WHEN m.depth = 0 THEN '-' ELSE right(lpad(bin(m.key >> (48 - m.depth)), 48, '0'), m.depth::INT) END AS shard,
  f.b::BIGINT AS shard_bytes, f.n::BIGINT AS shard_docs, f.b > 8388608 AS oversize
FROM m JOIN f ON f.depth = m.depth AND f.bucket = m.key >> (48 - m.depth)
"""
