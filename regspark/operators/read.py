"""Lookup, listing and navigation over keys and values.

keys: path, path_norm, parent_path, name, depth, last_write.
values: key_path, name, reg_type and data columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cols as c


def norm(path: str) -> str:
    """The normal form of one path, as norm_path() gives it for a column."""
    from ..schema import ROOTS

    parts = [p.strip() for p in path.replace("/", c.SEP).split(c.SEP) if p.strip()]
    if parts and parts[0].upper() in ROOTS:
        parts = parts[1:]
    return c.SEP.join(parts).lower()


def find(keys: DataFrame, path: str) -> DataFrame:
    """The key at a path; case, separators and a root's name do not matter."""
    return keys.where(F.col("path_norm") == norm(path))


def get_child(keys: DataFrame, parent: str, name: str) -> DataFrame:
    """The child of that name: a path, so the filter reaches a stored table."""
    top = norm(parent)
    return keys.where(F.col("path_norm") == (f"{top}{c.SEP}{name.lower()}" if top else name.lower()))


def match_children(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: parent_path and name. Keys that match, by parent and hash of the name first, then by the name itself."""
    side = lambda df, p, n: df.withColumns({"_p": F.lower(p), "_h": c.lh_hash(n), "_n": F.upper(n)})
    w = side(wanted, "parent_path", "name").select("_p", "_h", "_n").distinct()
    return side(keys, "parent_path", "name").join(w, ["_p", "_h", "_n"], "left_semi").select(keys.columns)


def annotate(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """The paths of a plan and those above them, with whether the store has each and how many operations aim at it."""
    way = ops.select(F.explode(c.ancestors("path_norm", itself=True)).alias("path_norm")).distinct()
    aimed = ops.groupBy("path_norm").agg(F.count("*").alias("n_ops"))
    there = keys.select("path_norm").distinct().withColumn("there", F.lit(True))
    out = way.join(aimed, "path_norm", "left").join(there, "path_norm", "left")
    return out.select("path_norm", F.coalesce("n_ops", F.lit(0)).alias("n_ops"), F.coalesce("there", F.lit(False)).alias("exists"))


def list_keys(keys: DataFrame, top: str = "", recursive: bool = True, max_depth: int | None = None) -> DataFrame:
    """Keys under `top`, without it; max_depth counts from it. Unsorted: sort by path to print."""
    top = norm(top)
    base = len(top.split(c.SEP)) if top else 0
    most = 1 if not recursive else max_depth
    out = keys.where(c.under("path_norm", top))
    return out if most is None else out.where(F.col("depth") <= base + most)


def parent_of(keys: DataFrame, path: str) -> DataFrame:
    """The parent key; none for a key below the root."""
    p = norm(path)
    return keys.where(F.col("path_norm") == p.rpartition(c.SEP)[0]) if c.SEP in p else keys.where("false")


def list_values(values: DataFrame, path: str) -> DataFrame:
    """Values of a key; where the table has key_norm, the filter reaches it."""
    key = F.col("key_norm") if "key_norm" in values.columns else c.norm_path("key_path")
    return values.where(key == norm(path))


def get_value(values: DataFrame, path: str, name: str) -> DataFrame:
    return list_values(values, path).where(F.lower("name") == name.lower())


def with_counts(keys: DataFrame, values: DataFrame) -> DataFrame:
    """Adds subkey_n and value_n."""
    kids = keys.groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("subkey_n"))
    vals = values.groupBy(F.col("key_path").alias("path")).agg(F.count("*").alias("value_n"))
    out = keys.join(kids, "path", "left").join(vals, "path", "left")
    return out.withColumns({x: F.coalesce(x, F.lit(0)) for x in ("subkey_n", "value_n")})


def tree(keys: DataFrame, top: str = "", max_depth: int | None = None) -> DataFrame:
    """Keys in pre-order by `preorder_key`, the lower-cased parts of the path, children by name."""
    return list_keys(keys, top, True, max_depth).withColumn("preorder_key", F.split("path_norm", r"\\"))


def walk(edges: DataFrame, root: DataFrame) -> DataFrame:
    """Nodes reachable from root over (parent, child) offsets, level by level; a node met again is not followed.

    edges: parent, child. root: node. Returns node and level. Each level is a
    join with the last one only; lineage is cut by a checkpoint every few levels
    where there is a folder for it. It ends when a level is empty, however deep.
    """
    seen = root.select("node").distinct().withColumn("level", F.lit(0))
    last, level, held = seen, 0, []
    while True:
        level += 1
        new = last.join(edges, last.node == edges.parent).select(F.col("child").alias("node")).distinct()
        new = new.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level)).persist()
        held.append(new)
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
        if level % 8 == 0 and edges.sparkSession.sparkContext.getCheckpointDir():
            seen = seen.checkpoint()
            for x in held[:-1]:
                x.unpersist()
            held = held[-1:]
        last = new


def missing(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: path. Those that no key has."""
    w = wanted.withColumn("path_norm", c.norm_path("path"))
    return w.join(keys.select("path_norm"), "path_norm", "left_anti").select("path")


def present(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    w = wanted.withColumn("path_norm", c.norm_path("path"))
    return w.join(keys.select("path_norm"), "path_norm", "left_semi").select("path")


def presence(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: n_present, n_missing and all_present."""
    w = wanted.select(c.norm_path("path").alias("path_norm"))
    k = keys.select("path_norm").distinct().withColumn("hit", F.lit(True))
    j = w.join(k, "path_norm", "left")
    return j.agg(F.count_if("hit").alias("n_present"), F.count_if(F.col("hit").isNull()).alias("n_missing"), F.coalesce(F.bool_and(F.coalesce("hit", F.lit(False))), F.lit(True)).alias("all_present"))


def can_delete(keys: DataFrame, path: str, recursive: bool = False) -> DataFrame:
    """subkeys below a key, and whether it may be deleted."""
    p = norm(path)
    return keys.where(c.under("path_norm", p)).agg(F.count("*").alias("subkeys")).withColumn("allowed", F.lit(recursive) | (F.col("subkeys") == 0))
