"""Predicates over files as columns, rules on them, and combinators of rules. A rule gives a table of violations.

Files have path, is_dir, depth and optionally size_bytes, layer, deps (array of paths) and refs (incoming references).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.globs import glob_match, glob_regex
from sylva.functions.paths import basename, extension

VIOLATION = ["rule", "path", "message"]


def name() -> Column:
    return basename(F.col("path"))



def path_matches(glob: str) -> Column:
    return glob_match(F.col("path"), glob, "match")


def path_contains(s: str) -> Column:
    return F.contains(F.col("path"), F.lit(s))


def path_starts_with(s: str) -> Column:
    return F.col("path").startswith(s)


def path_ends_with(s: str) -> Column:
    return F.col("path").endswith(s)


def path_regex(r: str) -> Column:
    return F.col("path").rlike(r)


def is_file() -> Column:
    return ~F.col("is_dir")


def is_directory() -> Column:
    return F.col("is_dir")


def has_extension(e: str) -> Column:
    return extension(F.col("path")) == e


def in_layer(layer: str) -> Column:
    return F.coalesce(F.col("layer") == layer, F.lit(False))


def has_layer() -> Column:
    return F.col("layer").isNotNull()


def depends_on(glob: str) -> Column:
    return F.exists("deps", lambda d: d.rlike(glob_regex(glob, "match") or "a^"))


def has_dependencies() -> Column:
    return F.size("deps") > 0


def has_incoming_refs() -> Column:
    return F.col("refs") > 0


def is_orphaned() -> Column:
    return ~has_dependencies() & ~has_incoming_refs()


def size_greater_than(n: int) -> Column:
    return is_file() & (F.col("size_bytes") > n)


def size_less_than(n: int) -> Column:
    return is_file() & (F.col("size_bytes") < n)


def depth_equals(n: int) -> Column:
    return F.col("depth") == n


def depth_greater_than(n: int) -> Column:
    return F.col("depth") > n


def depth_less_than(n: int) -> Column:
    return F.col("depth") < n


def name_matches(glob: str) -> Column:
    return name().rlike(glob_regex(glob, "match") or "a^")


def name_contains(s: str) -> Column:
    return F.contains(name(), F.lit(s))


def name_regex(r: str) -> Column:
    return name().rlike(r)


def every(*p: Column) -> Column:
    return reduce(lambda a, b: a & b, p, F.lit(True))


def either(*p: Column) -> Column:
    return reduce(lambda a, b: a | b, p, F.lit(False))


def none_of(*p: Column) -> Column:
    return ~either(*p)


def custom(f: Callable[[DataFrame], Column], files: DataFrame) -> Column:
    return f(files)


def violations(rows: DataFrame, rule: str, message: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col("path"), message.alias("message"))


def disallow_where(files: DataFrame, rule: str, predicate: Column, message: str) -> DataFrame:
    return violations(files.where(predicate), rule, F.lit(message))


def require_file(files: DataFrame, rule: str, predicate: Column, message: str) -> DataFrame:
    """One row with the path "." if no file satisfies the predicate."""
    n = files.where(predicate).limit(1).agg(F.count("*").alias("n"))
    return n.where("n = 0").select(F.lit(rule).alias("rule"), F.lit(".").alias("path"), F.lit(message).alias("message"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def all_of(rule: str, **children: DataFrame) -> DataFrame:
    """The violations of all rules, each named rule[child]."""
    return union_all([c.withColumn("rule", F.lit(f"{rule}[{n}]")) for n, c in children.items()])


def _passes(children: dict[str, DataFrame]) -> DataFrame:
    """One row: how many children have no violation (passed), and how many there are."""
    counts = union_all([c.limit(1).agg(F.count("*").alias("n")) for c in children.values()])
    return counts.agg(F.sum((F.col("n") == 0).cast("int")).alias("passed"), F.count("*").alias("children"))


def _summary(rule: str, rows: DataFrame, message: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(".").alias("path"), F.lit(message).alias("message"))


def any_of(rule: str, **children: DataFrame) -> DataFrame:
    return _summary(rule, _passes(children).where("passed = 0"), "none of the alternatives holds")


def not_rule(rule: str, child: DataFrame) -> DataFrame:
    return _summary(rule, _passes({"child": child}).where("passed = 1"), "the negated rule holds")


def exactly_one_of(rule: str, **children: DataFrame) -> DataFrame:
    return _summary(rule, _passes(children).where("passed != 1"), "not exactly one alternative holds")


def conditional(files: DataFrame, when: Column, child: DataFrame) -> DataFrame:
    """The child's violations if any file satisfies the condition (a join with one row at most)."""
    return child.join(F.broadcast(files.where(when).limit(1).select(F.lit(1).alias("_on"))), F.lit(True), "left_semi")
