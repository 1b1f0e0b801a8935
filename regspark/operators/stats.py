"""Statistics over trees, values and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cols as c


def totals(keys: DataFrame, values: DataFrame) -> DataFrame:
    k = keys.agg(F.count("*").alias("n_keys"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    return k.join(values.agg(F.count("*").alias("n_values"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size")))  # one row each


def by_level(keys: DataFrame, most: int | None = None) -> DataFrame:
    """n of each level; those beyond `most` are left out only where it is given."""
    return (keys if most is None else keys.where(F.col("depth") <= most)).groupBy("depth").agg(F.count("*").alias("n"))


def by_type(values: DataFrame) -> DataFrame:
    """n and percent per type; the total is a sum over the few groups."""
    g = values.groupBy("reg_type").agg(F.count("*").alias("n"))
    return g.select(c.type_name("reg_type").alias("type_name"), "n", F.round(c.percent(F.col("n"), F.sum("n").over(Window.partitionBy())), 4).alias("pct"))


def size_bucket(size: Column | str) -> Column:
    s = F.col(size) if isinstance(size, str) else size
    return F.when(s < 100, "<100").when(s < 1024, "100-1K").when(s < 10240, "1K-10K").otherwise(">10K")


def size_buckets(values: DataFrame) -> DataFrame:
    return values.groupBy(size_bucket("size").alias("bucket")).agg(F.count("*").alias("n"))


def largest_key(keys: DataFrame) -> DataFrame:
    """The key with most subkeys, the first by path of several; none if no key has any."""
    kids = keys.where("parent_path <> ''").groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("subkey_n"))
    return kids.orderBy(F.desc("subkey_n"), "path").limit(1)


def largest_value(values: DataFrame) -> DataFrame:
    return values.where("size > 0").orderBy(F.desc("size"), "key_path", "name").limit(1).select("key_path", "name", "size")


def worst_bins(cells: DataFrame, bin_col: str, capacity: Column, k: int = 20) -> DataFrame:
    """The k bins with the least of their capacity in use. cells: the bin, size (allocated bytes)."""
    g = cells.groupBy(bin_col).agg(F.sum("size").alias("used"), capacity.alias("capacity"))
    g = g.withColumn("efficiency", F.round(c.percent(F.col("used"), F.col("capacity")), 4))
    return g.orderBy("efficiency", bin_col).limit(k)


def efficiency_classes(bins: DataFrame) -> DataFrame:
    e = F.col("efficiency")
    return bins.groupBy(F.when(e >= 100, "100").when(e >= 99, "99").when(e >= 98, "98").when(e >= 95, "95").otherwise("<95").alias("class")).agg(F.count("*").alias("n"), F.count_if(e < 80).alias("poor"))


def cell_counts(cells: DataFrame) -> DataFrame:
    """Cells by signature and use. cells: sig, allocated, size."""
    return cells.groupBy("sig", "allocated").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def cells_by_use(cells: DataFrame, refs: DataFrame) -> DataFrame:
    """Cells in use by signature and by what refers to them: n and bytes."""
    use = refs.select("hive_id", F.col("dst").alias("off"), "kind").distinct()
    c_ = cells.where("allocated").join(use, ["hive_id", "off"], "left").withColumn("kind", F.coalesce("kind", F.lit("root or none")))
    return c_.groupBy("hive_id", "sig", "kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def bin_use(hbins: DataFrame, cells: DataFrame) -> DataFrame:
    """hive_id, abs_off, used, capacity and efficiency of each bin, from its allocated cells."""
    used = cells.groupBy("hive_id", F.col("hbin_off").alias("abs_off")).agg(F.sum(F.when(F.col("allocated"), F.col("size")).otherwise(0)).alias("used"))
    b = hbins.select("hive_id", "abs_off", (F.col("size") - 32).alias("capacity")).join(used, ["hive_id", "abs_off"], "left")
    return b.withColumn("efficiency", F.round(c.percent(F.coalesce("used", F.lit(0)), F.col("capacity")), 4))


def bin_summary(bins: DataFrame) -> DataFrame:
    """Per hive: bins, the share in use over all, and the mean of the bins' shares."""
    return bins.groupBy("hive_id").agg(F.count("*").alias("n"), F.round(c.percent(F.sum("used"), F.sum("capacity")), 4).alias("overall"), F.round(F.avg("efficiency"), 4).alias("average"))


def log_counts(ops: DataFrame) -> DataFrame:
    """Per file of a parsed log: different keys, values set and deletes of either."""
    o = F.col("op")
    return ops.groupBy("file").agg(F.count_distinct(F.when(o == "create_key", F.col("path_norm"))).alias("n_keys"), F.count_if(o == "set_value").alias("n_values"), F.count_if(o.isin("delete_key", "delete_value")).alias("n_deletes"))


def storage(cells: DataFrame) -> DataFrame:
    free = F.sum(F.when(~F.col("allocated"), F.col("size")).otherwise(0))
    g = cells.groupBy("hive_id").agg(F.sum("size").alias("bytes"), free.alias("free"))
    return g.withColumn("free_pct", c.percent(F.col("free"), F.col("bytes")))


def subtree_counts(keys: DataFrame) -> DataFrame:
    """Descendants of every key that has some: each key counts once for each of its ancestors."""
    return keys.select(F.explode(c.ancestors("path")).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
