"""Mounting one tree under a path of another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cols as c

OVERWRITE, SKIP, ERROR = "overwrite", "skip", "error"


def mounted(df: DataFrame, path_col: str, mount: str, flatten: str | None = None) -> DataFrame:
    """Paths moved under `mount`; a first part equal to `flatten` is not repeated."""
    p = F.col(path_col)
    if flatten is not None:
        first = F.lower(F.substring_index(p, c.SEP, 1)) == flatten.lower()
        p = F.when(first, F.substring(p, F.lit(len(flatten) + 2), F.length(p))).otherwise(p)
    return df.withColumn(path_col, c.join_path(F.lit(mount), p))


def link_keys(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Keys of both, and of the way to what is mounted, alike without case; the parent's spelling wins, then the least."""
    way = child.select(F.explode(c.ancestors("path", itself=True)).alias("path"), F.lit(1).alias("side"))
    both = parent.select("path", F.lit(0).alias("side")).unionByName(way)
    return both.groupBy(F.lower("path").alias("path_norm")).agg(F.min(F.struct("side", "path")).alias("k")).select("k.path")


def conflicts(parent: DataFrame, child: DataFrame) -> DataFrame:
    """key_path and name of the child's values that the parent has too, without case."""
    key = [F.lower("key_path").alias("_p"), F.lower("name").alias("_n")]
    return child.select("key_path", "name", *key).join(parent.select(*key).distinct(), ["_p", "_n"], "left_semi").select("key_path", "name")


def link_values(parent: DataFrame, child: DataFrame, conflict: str = OVERWRITE) -> DataFrame:
    """Values of both; where both have one (without case), the strategy decides."""
    key = lambda df: df.withColumns({"_p": F.lower("key_path"), "_n": F.lower("name")})
    p, ch = key(parent), key(child)
    on = ["_p", "_n"]
    if conflict == OVERWRITE:
        return p.join(ch.select(on), on, "left_anti").unionByName(ch.select(p.columns)).drop(*on)
    if conflict == SKIP:
        return p.unionByName(ch.join(p.select(on), on, "left_anti").select(p.columns)).drop(*on)
    both = ch.join(p.select(*on, F.lit(True).alias("_both")), on, "left")
    fine = both.where(F.when(F.col("_both"), F.raise_error(F.concat(F.lit("value in both trees: "), "key_path", F.lit(" "), "name")).cast("boolean")).otherwise(True))
    return p.unionByName(fine.select(p.columns)).drop(*on)
