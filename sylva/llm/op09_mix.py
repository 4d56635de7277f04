r"""Mixing sources to target weights along a time-varying curriculum.

Targets: every source has a weight; together they take SHARE of all words, but none more than MAX_REPEATS times its own
size. Weighted water-filling: sources in the order of cap / weight are full while the level that fills them costs no more
than the total; the others share the rest by weight.

Curriculum: a source has a schedule, a piecewise linear density over training time [0, 1]. Its integral F, scaled to the
target, is the source's cumulative demand of words; the word at place c of the source's stream (its documents in the
order of md5(doc_id), gone through MAX_REPEATS times at most) is trained at F^-1(c / target). Documents are range-sorted
by that position. The document at which the demand ends is taken in part (words=exact) or, with whole=True, as often as
rounding to whole documents says.

The places come from a two-level prefix sum: streams are cut by the first hex digits of the hash into 4096 buckets, so a
source with a third of all rows is spread over 4096 small windows; bucket totals are summed per source.

Defined results: null text has size 0; a null source is a source, the last; null doc_ids are kept (hash of the empty
string); documents of size 0 take 0 words; equal hashes go by doc_id, then size; an empty table gives an empty table;
columns that the result doesn't name are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.llm.common import WORD, materialise, table

WEIGHTS, SHARE, MAX_REPEATS = (3, 1, 2), 1.5, 2
#: Densities over training time as (time, weight) knots, dealt out to the sources in turn: rising, falling, level.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.6), (0.5, 0.8), (1.0, 0.8)), ((0.0, 1.0), (1.0, 1.0)))
BUCKET_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def turn(values: tuple, rank: Column) -> Column:
    """values dealt out in turn by rank (from 0)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source, rank, source_size, target. Windows here run over sources, not over documents."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    s = s.withColumn("weight", turn(weights, F.col("rank")).cast("double")).withColumn("cap", F.lit(cap) * F.col("source_size"))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    s = s.withColumn("total", share * F.sum("source_size").over(every)).withColumn("all_w", F.sum("weight").over(every))
    s = s.withColumn("cum_cap", F.sum("cap").over(fill)).withColumn("cum_w", F.sum("weight").over(fill))
    s = s.withColumn("full", F.col("cum_cap") + F.col("cap") / F.col("weight") * (F.col("all_w") - F.col("cum_w")) <= F.col("total"))
    rest_cap = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)
    rest_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    s = s.withColumn("rest_cap", rest_cap).withColumn("rest_w", rest_w)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * (F.col("total") - F.col("rest_cap")) / F.nullif(F.col("rest_w"), F.lit(0.0)))
    return s.select("source", "rank", "source_size", F.least(target, F.col("cap").cast("double")).alias("target"))


def inverse_demand(share: Column, knots: tuple) -> Column:
    """The time by which share (0 to 1) of a schedule's integral has gone by: the quadratic of its segment solved."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total, done, out = sum(areas), 0.0, F.lit(1.0)
    pieces = []
    for (a, b), area in zip(zip(knots, knots[1:]), areas):
        slope, rest = (b[1] - a[1]) / (b[0] - a[0]), share * total - done
        t = rest / a[1] if slope == 0 else (F.sqrt(F.greatest(F.lit(a[1] * a[1]) + 2 * slope * rest, F.lit(0.0))) - a[1]) / slope
        pieces.append((share * total <= done + area, F.least(F.lit(b[0]), F.lit(a[0]) + t)))
        done += area
    for cond, value in reversed(pieces):
        out = F.when(cond, value).otherwise(out)
    return out


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = MAX_REPEATS, schedules: tuple = SCHEDULES, whole: bool = False, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, position (of the first pass; null if not taken).

    With carry the rows have the document's other columns as a struct `doc`.
    """
    cols = ["doc_id", "source"] if not carry else ["doc_id", "source", F.struct(*[docs[c] for c in docs.columns]).alias("doc")]
    sized = docs.select(*cols, n_words(docs["text"]).alias("size"))
    sized = sized.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    if not carry:
        sized = materialise(sized, "sized")
    targets = materialise(source_targets(sized.select("source", "size"), weights, share, cap), "targets")
    small = sized.select("source", "size", "hash").withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))
    totals = small.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.withColumn("before", F.coalesce(before, F.lit(0)))
    t = targets.withColumnRenamed("source", "_s")
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))  # never null: window and join share one shuffle
    offsets = offsets.join(t, offsets["source"].eqNullSafe(t["_s"])).select(key.alias("_k"), F.col("bucket"), "before", "rank", "source_size", "target")
    rows = sized.withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS)).withColumn("_k", key)
    own = Window.partitionBy("_k", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0)))
    rows = rows.join(offsets, ["_k", "bucket"]).withColumn("place", F.col("before") + F.col("within"))
    demand = F.floor(F.col("target") + 1e-6)
    passes = [demand - F.col("place") - p * F.col("source_size") for p in range(cap)]
    if whole:  # a pass takes a document whose first half still falls into the demand
        taken = [F.when((F.col("size") > 0) & (2 * x >= F.col("size")), F.col("size")).otherwise(0) for x in passes]
    else:
        taken = [F.least(F.greatest(x, F.lit(0)), F.col("size")) for x in passes]
    at = F.col("place") / F.nullif(F.col("target"), F.lit(0.0))
    position = reduce(lambda out, k: F.when(F.col("rank") % len(schedules) == k, inverse_demand(at, schedules[k])).otherwise(out), range(len(schedules)), F.lit(None).cast("double"))
    again = reduce(lambda out, k: F.when(F.col("rank") % len(schedules) == k, inverse_demand((F.col("place") + F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0)), schedules[k])).otherwise(out), range(len(schedules)), F.lit(None).cast("double"))
    total = reduce(lambda a, b: a + b, taken)
    rows = rows.withColumn("taken", total.cast("bigint")).withColumn("copies", reduce(lambda a, b: a + b, [(x > 0).cast("int") for x in taken]))
    rows = rows.withColumn("position", F.when(F.col("copies") > 0, position)).withColumn("position_again", F.when(F.col("copies") > 1, again))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies", "position", "position_again", *(["doc"] if carry else []))


def training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by position; what isn't taken comes last."""
    return mixed.repartitionByRange(F.asc_nulls_last("position"), F.col("doc_id")).sortWithinPartitions(F.asc_nulls_last("position"), "doc_id")


def training_documents(docs: DataFrame) -> DataFrame:
    """The documents in the order of training, a repeated one once for each pass; with the columns of docs."""
    m = materialise(mix(docs, whole=True, carry=True).where("copies > 0"), "taken")  # the shuffle of the window goes before the sort
    both = m.select("doc", F.explode(F.array_compact(F.array("position", "position_again"))).alias("_at"))
    return both.repartitionByRange("_at").sortWithinPartitions("_at").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return training_order(m).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS w FROM s),
f AS (SELECT *, 2 * source_size AS cap, 1.5 * sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
        sum(2 * source_size) OVER o AS cum_cap, sum(w) OVER o AS cum_w FROM r WINDOW o AS (ORDER BY 2 * source_size / w, source)),
g AS (SELECT *, cum_cap + cap / w * (all_w - cum_w) <= total AS is_full FROM f),
k AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
        w * (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target FROM g),
p AS (SELECT d.doc_id, d.size, k.source_size, k.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
  (least(greatest(floor(target + 1e-6) - place, 0), size) + least(greatest(floor(target + 1e-6) - place - source_size, 0), size))::BIGINT AS taken
FROM p
"""
