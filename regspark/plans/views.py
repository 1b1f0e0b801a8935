"""Star-schema tables seen as registry trees and change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cols as c
from ..schema import CREATE, DELETE_KEY, DELETE_VALUE, SET


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their paths; the small geography sides are left to the optimiser's size check."""
    r, n = _t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation")
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws(c.SEP, "r_name", "n_name").alias("place"))
    cust = _t(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return cust.withColumn("cpath", F.concat_ws(c.SEP, "place", F.concat(F.lit("C"), "c_custkey")))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = _customers(spark, sf_dir).select("c_custkey", "cpath")
    orders = _t(spark, sf_dir, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return orders.withColumn("opath", F.concat_ws(c.SEP, "cpath", F.concat(F.lit("O"), "o_orderkey")))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, name, parent_path, depth and last_write (seconds) of regions, nations, customers and orders."""
    r, n = _t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation")
    zero = F.lit(0).cast("long")
    top = r.select(F.col("r_name").alias("path"), F.lit(1).alias("depth"), zero.alias("last_write"))
    mid = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(c.SEP, "r_name", "n_name").alias("path"), F.lit(2).alias("depth"), zero.alias("last_write"))
    low = _customers(spark, sf_dir).select(F.col("cpath").alias("path"), F.lit(3).alias("depth"), zero.alias("last_write"))
    leaf = _orders(spark, sf_dir).select(F.col("opath").alias("path"), F.lit(4).alias("depth"), _seconds("o_orderdate").alias("last_write"))
    out = top.unionByName(mid).unionByName(low).unionByName(leaf)
    return out.select("path", F.lower("path").alias("path_norm"), c.parent("path").alias("parent_path"), c.last_part("path").alias("name"), "depth", "last_write")


def _typed(name: str, kind: int, value: Column) -> Column:
    text = value.cast("string")
    size = (F.length(text) + 1) * 2 if kind == 1 else F.lit(4 if kind == 4 else 8)
    none = F.lit(None)
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(kind).alias("reg_type"),
        size.cast("long").alias("size"),
        (text if kind == 1 else none.cast("string")).alias("string_val"),
        (value.cast("long") if kind != 1 else none.cast("long")).alias("number_val"),
    )


def _unpivot(rows: DataFrame, path: str, *values: Column) -> DataFrame:
    return rows.select(F.col(path).alias("key_path"), F.explode(F.array(*values)).alias("v")).select("key_path", "v.*")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key_path, name, reg_type, size, string_val and number_val of customers' and orders' columns."""
    low = _unpivot(_customers(spark, sf_dir), "cpath", _typed("Segment", 1, F.col("c_mktsegment")), _typed("Nation", 4, F.col("c_nationkey")), _typed("Key", 11, F.col("c_custkey")))
    leaf = _unpivot(_orders(spark, sf_dir), "opath", _typed("Status", 1, F.col("o_orderstatus")), _typed("Key", 11, F.col("o_orderkey")), _typed("", 1, F.col("o_orderpriority")))
    return low.unionByName(leaf).withColumn("key_norm", F.lower("key_path"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """(keys, values) of orders before and after: some keys are new, some gone, some statuses changed."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", _seconds("o_orderdate").alias("w"))
    path = F.concat(F.lit("Orders\\D"), F.col("o_orderkey") % 100, F.lit("\\O"), F.col("o_orderkey"))

    def one(rows: DataFrame, status: Column) -> tuple[DataFrame, DataFrame]:
        k = rows.select(path.alias("path"), F.col("w").alias("last_write"))
        v = _unpivot(rows.withColumn("p", path), "p", _typed("Status", 1, status), _typed("", 1, F.col("o_orderpriority")))
        return k, v

    status = F.col("o_orderstatus")
    changed = F.when(F.col("o_orderkey") % 7 == 0, F.lit("X")).otherwise(status)
    return one(o.where("o_orderkey % 10 <> 0"), status), one(o.where("o_orderkey % 10 <> 1"), changed)


def edit_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as a change log: seq (a comparable struct), op, path, name and number.

    The order is by time, then id. It stays a struct: numbering all rows would
    send them through one task.
    """
    e = _t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    path = F.concat(F.lit("users\\u"), F.col("user_id") % 5, F.lit("\\t"), "user_id", F.when(F.col("k") % 3 != 0, F.concat(F.lit("\\k"), F.col("k") % 7)).otherwise(""))
    op = F.when(F.col("event_type") == "signup", CREATE).when(F.col("event_type") == "error", F.when(F.col("k") % 4 == 0, DELETE_KEY).otherwise(DELETE_VALUE)).otherwise(SET)
    seq = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("id"))
    name = F.when(F.col("k") % 5 == 0, F.lit("")).otherwise(F.col("event_type"))
    return e.select(seq.alias("seq"), op.alias("op"), path.alias("path"), F.when(op.isin(SET, DELETE_VALUE), name).alias("name"), F.when(op == SET, F.round(F.col("value") * 100).cast("long")).alias("number"))
