"""Change logs: what can be left out, the order of a plan, prefixes and JSON patches.

ops: seq (unique and comparable), op, path, path_norm, name and data columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cols as c
from ..schema import CREATE, DELETE_KEY, DELETE_VALUE, PRIORITY, SET


def _target() -> list[Column]:
    """Operations on one target replace each other. Keys and unnamed values are different targets."""
    kind = F.when(F.col("op") == DELETE_KEY, "d").when(F.col("op") == CREATE, "k").otherwise("v")
    return [F.col("path_norm"), F.coalesce("name", F.lit("")).alias("name"), kind.alias("kind")]


def dedup(ops: DataFrame) -> DataFrame:
    """The last operation on each target."""
    row = F.struct(*ops.columns)
    return ops.groupBy(*_target()).agg(F.max_by(row, "seq").alias("r")).select("r.*")


def deletes_above(rows: DataFrame, ops: DataFrame) -> DataFrame:
    """rows, each with the last delete (`del`) of its path_norm and of each key above it, as far as there is one.

    A row meets only keys at depths where something is deleted, and each task holds its share of
    the deletes, of which a path has one, so that a key that all others are below costs no memory.
    """
    gone = ops.where(F.col("op") == DELETE_KEY).groupBy(F.col("path_norm").alias("top")).agg(F.max("seq").alias("del"))
    depths = gone.agg(F.collect_set(c.depth("top")).alias("depths"))  # one row
    tops = F.filter(c.ancestors("path_norm", itself=True), lambda x: F.array_contains("depths", c.depth(x)))
    way = rows.crossJoin(F.broadcast(depths)).withColumn("top", F.explode(tops)).drop("depths")
    return way.join(gone.hint("shuffle_hash"), "top")


def shadowed(ops: DataFrame) -> DataFrame:
    """seq of the operations that a later delete of their key or an ancestor undoes."""
    return deletes_above(ops.select("seq", "path_norm"), ops).where("del > seq").select("seq").distinct()


def drop_shadowed(ops: DataFrame) -> DataFrame:
    return ops.join(shadowed(ops), "seq", "left_anti").select(ops.columns)


def priority(op: Column | str) -> Column:
    o = F.col(op) if isinstance(op, str) else op
    out = None
    for k, v in PRIORITY.items():
        out = F.when(o == k, v) if out is None else out.when(o == k, v)
    return out


def plan_order(ops: DataFrame) -> DataFrame:
    """Adds depth and prio; a plan runs by depth, path, prio, seq."""
    return ops.withColumns({"depth": c.depth("path_norm"), "prio": priority("op")})


def optimize(ops: DataFrame, dedup_ops: bool = True, drop_dead: bool = True) -> DataFrame:
    out = dedup(ops) if dedup_ops else ops
    # deletes that are left still shadow what came before them
    return plan_order(drop_shadowed(out) if drop_dead else out)


def optimize_stats(ops: DataFrame) -> DataFrame:
    """n_in, n_dedup, n_out and the percentage left out."""
    d = dedup(ops)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(ops, "n_in").join(n(d, "n_dedup")).join(n(drop_shadowed(d), "n_out"))  # one row each
    return out.withColumn("reduction_pct", F.round(c.percent(F.col("n_in") - F.col("n_out"), F.col("n_in")), 4))


def with_prefix(ops: DataFrame, prefix: str) -> DataFrame:
    """All paths moved under a prefix, roots' names taken off both."""
    p = F.concat_ws(c.SEP, c.clean_path(F.lit(prefix)), F.when(c.clean_path("path") != "", c.clean_path("path")))
    return ops.withColumn("path", p).withColumn("path_norm", F.lower("path"))


def concat_logs(*logs: DataFrame) -> DataFrame:
    """Logs one after the other: seq becomes (place of the log, seq)."""
    out = None
    for i, log in enumerate(logs):
        x = log.withColumns({"file_idx": F.lit(i), "seq": F.struct(F.lit(i).alias("file"), F.col("seq").alias("seq"))})
        out = x if out is None else out.unionByName(x)
    return out


PATCH = "struct<op:string,key_path:array<string>,value_name:string,value_type:string,data:string>"


def to_patch(ops: DataFrame) -> DataFrame:
    """One JSON object for each operation; data in base64."""
    body = F.struct("op", F.split("path", r"\\").alias("key_path"), F.col("name").alias("value_name"), c.type_name("reg_type").alias("value_type"), F.base64("data").alias("data"))
    return ops.select("seq", F.to_json(body).alias("patch"))


def from_patch(lines: DataFrame) -> DataFrame:
    """Operations of JSON objects; data is base64 text or an array of byte numbers."""
    p = F.from_json("patch", PATCH)
    listed = F.get_json_object("patch", "$.data").startswith("[")
    numbers = F.from_json(F.get_json_object("patch", "$.data"), "array<int>")
    raw = F.unhex(F.array_join(F.transform(numbers, lambda n: F.lpad(F.hex(n), 2, "0")), ""))
    rows = lines.select("seq", p.alias("p"), F.when(listed, raw).otherwise(F.unbase64(F.get_json_object("patch", "$.data"))).alias("data"))
    path = F.array_join("p.key_path", c.SEP)
    return rows.select("seq", F.col("p.op").alias("op"), path.alias("path"), c.norm_path(path).alias("path_norm"), F.col("p.value_name").alias("name"), c.type_code("p.value_type").alias("reg_type"), "data")


def parse_value(text: Column | str, kind: Column | str) -> Column:
    """Bytes of a command-line value: text, decimal or 0x numbers, or hex digits."""
    t = F.col(text) if isinstance(text, str) else text
    k = c.type_code(kind)
    number = F.when(F.lower(t).startswith("0x"), F.conv(F.substring(t, F.lit(3), F.length(t)), 16, 10)).otherwise(t).try_cast("long") if hasattr(t, "try_cast") else t.cast("long")
    return F.when(k.isin(1, 2), c.sz_bytes(t)).when(k == 4, c.dword_bytes(number)).when(k == 5, c.dword_bytes(number, True)).when(k == 11, c.qword_bytes(number)).when(k == 7, c.multi_sz_bytes(F.split(t, ","))).otherwise(F.unhex(F.regexp_replace(t, r"[\s,]|^0x", "")))
