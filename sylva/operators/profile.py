"""A project's profile: limits that fit it, its languages and documentation, and a configuration made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.paths import basename
from sylva.operators.structure import directories


def _clamp(c, low: int, high: int):
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def recommended_limits(files: DataFrame) -> DataFrame:
    """One row: max_depth, max_files, max_subdirs, a little above what the files have, within fixed bounds."""
    most = directories(files).agg(F.max("file_count").alias("f"), F.max("subdir_count").alias("s"))
    deep = files.agg(F.max("depth").alias("d"))
    of = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = deep.join(most, how="cross")  # one row each
    return both.select(_clamp(of("d") + 2, 4, 10).cast("bigint").alias("max_depth"), _clamp(F.floor(of("f") * 1.2), 20, 100).cast("bigint").alias("max_files"), _clamp(of("s") + 3, 10, 30).cast("bigint").alias("max_subdirs"))


def documentation(files: DataFrame) -> DataFrame:
    """One row: readmes, directories, documented (more than half of the directories have one)."""
    is_readme = F.lower(basename(F.col("path"))).startswith("readme")
    n = files.where("not is_dir").agg(F.count_if(is_readme).alias("readmes"), F.count_distinct("parent_path").alias("directories"))
    return n.withColumn("documented", F.coalesce(F.col("readmes") / F.nullif(F.col("directories"), F.lit(0)) > 0.5, F.lit(False)))


def generated_config(files: DataFrame, exclude: tuple[str, ...] = ()) -> str:
    """YAML of a configuration with the recommended limits (one row comes to the driver)."""
    import yaml

    limits = recommended_limits(files).first()
    rules = {"max-depth": {"max": limits["max_depth"]}, "max-files-in-dir": {"max": limits["max_files"]}, "max-subdirs": {"max": limits["max_subdirs"]}}
    return yaml.safe_dump({"root": True, "exclude": list(exclude), "rules": rules}, sort_keys=False)
