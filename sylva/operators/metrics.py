"""Metrics over tokens and nesting: Halstead counts, cognitive complexity, and their rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def halstead(tokens: DataFrame, key: str) -> DataFrame:
    """tokens: key, value, is_operator. n1, n2 distinct and N1, N2 total operators and operands; volume, difficulty, effort."""
    op, no = F.col("is_operator"), ~F.col("is_operator")
    h = tokens.groupBy(key).agg(F.count_distinct(F.when(op, F.col("value"))).alias("n1"), F.count_distinct(F.when(no, F.col("value"))).alias("n2"), F.count_if(op).alias("big_n1"), F.count_if(no).alias("big_n2"))
    return halstead_values(h)


def halstead_values(h: DataFrame) -> DataFrame:
    """volume, difficulty and effort beside n1, n2, big_n1 and big_n2."""
    n, total = F.col("n1") + F.col("n2"), F.col("big_n1") + F.col("big_n2")
    volume = F.when(n > 0, total * F.log2(n)).otherwise(0.0)
    difficulty = F.when(F.col("n2") > 0, F.col("n1") / 2 * F.col("big_n2") / F.col("n2")).otherwise(0.0)
    return h.withColumn("volume", volume).withColumn("difficulty", difficulty).withColumn("effort", volume * difficulty)


def cognitive(nodes: DataFrame, key: str, order: str, step: Column, counts: Column) -> DataFrame:
    """Sum over counted nodes of 1 + the nesting before them; step is +1 where a level opens and -1 where it closes."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.withColumn("nesting", F.greatest(F.coalesce(F.sum(step).over(w), F.lit(0)), F.lit(0)))
    return rows.groupBy(key).agg(F.sum(F.when(counts, 1 + F.col("nesting")).otherwise(0)).alias("complexity"))


def rollup(values: DataFrame, key: str, value: str) -> DataFrame:
    return values.groupBy(key).agg(F.sum(value).alias("total"), F.avg(value).alias("average"), F.max(value).alias("most"), F.count("*").alias("functions"))
