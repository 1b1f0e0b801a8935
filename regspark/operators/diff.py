"""Differences of two snapshots; paths and names are compared with their case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cols as c

STATUSES = ("added", "removed", "modified", "unchanged")


def _status(old: Column, new: Column, changed: Column) -> Column:
    return F.when(old.isNull(), "added").when(new.isNull(), "removed").when(changed, "modified").otherwise("unchanged")


def diff_values(old: DataFrame, new: DataFrame, data: tuple[str, ...] = ("data",)) -> DataFrame:
    """key_path, name and status; a value is modified if its type, its size or any data column differs."""
    cols = ("reg_type", "size", *data)
    side = lambda df, s: df.select("key_path", "name", F.struct(*cols).alias(s))
    j = side(old, "old").join(side(new, "new"), ["key_path", "name"], "full_outer")
    changed = ~F.col("old").eqNullSafe(F.col("new"))
    return j.select("key_path", "name", _status(F.col("old"), F.col("new"), changed).alias("status"))


def diff_keys(old: DataFrame, new: DataFrame, value_diff: DataFrame) -> DataFrame:
    """path and status; a key in both is modified if its last write differs or one of its values does."""
    side = lambda df, s: df.select("path", F.struct("last_write").alias(s))
    j = side(old, "old").join(side(new, "new"), "path", "full_outer")
    touched = value_diff.where("status <> 'unchanged'").select(F.col("key_path").alias("path")).distinct().withColumn("touched", F.lit(True))
    j = j.join(touched, "path", "left")
    changed = F.col("touched").isNotNull() | ~F.col("old").eqNullSafe(F.col("new"))
    return j.select("path", _status(F.col("old"), F.col("new"), changed).alias("status"))


def common_values(value_diff: DataFrame, key_diff: DataFrame) -> DataFrame:
    """Value differences of keys that both sides have."""
    both = key_diff.where("status in ('modified', 'unchanged')").select(F.col("path").alias("key_path"))
    return value_diff.join(both, "key_path", "left_semi")


def filter_diff(key_diff: DataFrame, *statuses: str) -> DataFrame:
    """Keys of these statuses; unless unchanged ones are among them, with the listed keys above them (context)."""
    hit = key_diff.where(F.col("status").isin(*statuses)).withColumn("context", F.lit(False))
    if "unchanged" in statuses:
        return hit
    way = hit.select(F.explode(c.ancestors("path")).alias("path")).distinct()
    above = way.join(hit, "path", "left_anti").join(key_diff, "path", "left").withColumn("context", F.lit(True))
    return hit.unionByName(above.select("path", F.coalesce("status", F.lit("unchanged")).alias("status"), "context"))


def summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n"))


def unified(value_diff: DataFrame) -> DataFrame:
    """Lines of a text report."""
    sign = F.when(F.col("status") == "added", "+ ").when(F.col("status") == "removed", "- ").when(F.col("status") == "modified", "~ ").otherwise("  ")
    return value_diff.select("key_path", "name", F.concat(sign, "key_path", F.lit(" : "), F.when(F.col("name") == "", "(Default)").otherwise(F.col("name"))).alias("line"))
