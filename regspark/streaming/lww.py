"""The current state of a change log that arrives as a stream.

The last operation on each value and the last delete of each key are kept by a
native aggregation; late operations (with a smaller seq) change nothing. What is
alive follows from these rows, as in plans/apply.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cols as c
from ..schema import DELETE_KEY, DELETE_VALUE, SET


def current_values(ops: DataFrame) -> DataFrame:
    """ops: a stream of seq (long), op, path_norm, name and number. An update row whenever a target changes.

    Rows with a null name are deletes of keys.
    """
    touch = ops.where(F.col("op").isin(SET, DELETE_VALUE, DELETE_KEY)).withColumn("name", F.when(F.col("op") != DELETE_KEY, F.coalesce("name", F.lit(""))))
    last = F.max_by(F.struct("op", "number"), "seq").alias("v")
    out = touch.groupBy("path_norm", "name").agg(F.max("seq").alias("seq"), last)
    live = F.col("v.op") == SET
    return out.select("path_norm", "name", "seq", live.alias("live"), F.when(live, F.col("v.number")).alias("number"))


def alive(rows: DataFrame) -> DataFrame:
    """rows: a stored table of what current_values() has sent so far, updates included. The values that are there now."""
    last = rows.groupBy("path_norm", "name").agg(F.max("seq").alias("seq"), F.max_by("live", "seq").alias("live"), F.max_by("number", "seq").alias("number"))
    gone = last.where("name is null").groupBy(F.col("path_norm").alias("top")).agg(F.max("seq").alias("gone"))
    v = last.where("name is not null and live")
    way = v.select(F.col("path_norm").alias("p"), F.explode(c.ancestors("path_norm", itself=True)).alias("top")).distinct()
    dead = way.join(gone, "top").groupBy("p").agg(F.max("gone").alias("gone"))
    return v.join(dead, F.col("path_norm") == F.col("p"), "left").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone"))).select("path_norm", "name", "number")


def counts_by_window(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Operations per kind in tumbling windows; events: ts, op."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "op").agg(F.count("*").alias("n"))
