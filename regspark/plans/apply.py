"""Declarative replay of a change log over a snapshot.

The log's meaning is sequential; the plan is sets. With del(p) the last delete
of exactly p, and dead(p) the last of any ancestor or p itself:

* a key lives if the last creation at it or below it is later than dead(p);
* a value lives if the last operation on it is a set later than dead(p) of its key.

The snapshot is operations older than the log. A delete of the root is left
out; deleting a value creates no key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cols as c
from ..operators.oplog import deletes_above
from ..schema import CREATE, DELETE_KEY, DELETE_VALUE, SET


def _dead(paths: DataFrame, ops: DataFrame) -> DataFrame:
    """path_norm and dead (null for none) of each distinct path. Deletes are summed up before the join."""
    return deletes_above(paths.select("path_norm"), ops.where(F.col("path_norm") != "")).groupBy("path_norm").agg(F.max("del").alias("dead"))


def _after(seq: str, dead: str):
    return F.col(dead).isNull() | (F.col(seq) > F.col(dead))


def live_keys(ops: DataFrame) -> DataFrame:
    """path_norm, path (as first written) and seq of the keys that are there in the end.

    ops: seq (comparable), op, path, path_norm. The snapshot's keys are create operations with the least seqs.
    """
    made = ops.where(F.col("op").isin(CREATE, SET))
    last = made.groupBy("path_norm").agg(F.max("seq").alias("seq"), F.min_by("path", "seq").alias("path"))
    n = F.size(F.split("path_norm", r"\\"))
    # every creation also makes the keys above it
    way = last.select(F.explode(F.arrays_zip(c.ancestors("path_norm", True).alias("n"), c.ancestors("path", True).alias("p"))).alias("a"), "seq", n.alias("depth"))
    made = way.groupBy(F.col("a.n").alias("path_norm")).agg(F.max("seq").alias("seq"), F.min_by(F.col("a.p"), "seq").alias("path"))
    dead = _dead(made.select("path_norm"), ops)
    return made.join(dead, "path_norm", "left").where(_after("seq", "dead")).select("path_norm", "path", "seq")


def live_values(ops: DataFrame, fields: list[str]) -> DataFrame:
    """path_norm, name and fields of the values that are there in the end; names are alike without case."""
    touch = ops.where(F.col("op").isin(SET, DELETE_VALUE)).withColumn("name_norm", F.lower("name"))
    last = touch.groupBy("path_norm", "name_norm").agg(F.max_by(F.struct("op", "name", "path", *fields), "seq").alias("v"), F.max("seq").alias("seq"))
    last = last.where(F.col("v.op") == SET)
    dead = _dead(last.select("path_norm").distinct(), ops)
    alive = last.join(dead, "path_norm", "left").where(_after("seq", "dead"))
    return alive.select("path_norm", F.col("v.path").alias("path"), F.col("v.name").alias("name"), *(F.col(f"v.{f}").alias(f) for f in fields))


def snapshot_ops(keys: DataFrame, values: DataFrame, fields: list[str], zero) -> DataFrame:
    """A snapshot as operations at `zero`, a seq below all of the log."""
    k = keys.select(zero.alias("seq"), F.lit(CREATE).alias("op"), "path", c.norm_path("path").alias("path_norm"), F.lit(None).cast("string").alias("name"))
    v = values.select(zero.alias("seq"), F.lit(SET).alias("op"), F.col("key_path").alias("path"), c.norm_path("key_path").alias("path_norm"), "name", *fields)
    return k.unionByName(v, allowMissingColumns=True)


def applied(before: DataFrame, after: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """Net counts of rows created, deleted, changed and left as they were."""
    side = lambda df, s: df.select(*on, F.struct(F.lit(1).alias("there"), *fields).alias(s))
    j = side(before, "b").join(side(after, "a"), on, "full_outer")
    same = F.col("b").eqNullSafe(F.col("a"))
    return j.agg(
        F.count_if(F.col("b").isNull()).alias("n_created"),
        F.count_if(F.col("a").isNull()).alias("n_deleted"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & ~same).alias("n_changed"),
        F.count_if(same).alias("n_same"),
    )
