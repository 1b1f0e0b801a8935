"""One object for a registry tree: what the command line and library of such a store offer, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cols as c
from .operators import checks, diff, export, oplog, read, search, stats
from .plans import apply, link
from .schema import CREATE, DELETE_KEY, DELETE_VALUE, SET, Limits
from .sources import hivewriter, regf, regtext

_FIELDS = ["reg_type", "data"]


@dataclass
class Tree:
    """keys: path, path_norm, parent_path, name, depth, last_write. values: key_path, name, reg_type, size, data."""

    keys: DataFrame
    values: DataFrame
    #: Tables of the image it came from, by name; none for trees that came from logs.
    image: dict[str, DataFrame] | None = None

    # ---- sources

    @staticmethod
    def open(spark: SparkSession, path: str, tolerant: bool = True) -> Tree:
        """A tree of one image, or of many with the file as first part of their paths."""
        files = spark.read.format("binaryFile").load(path).select("path", "content")
        return Tree.from_images(files, tolerant)

    @staticmethod
    def from_images(files: DataFrame, tolerant: bool = True) -> Tree:
        t = regf.tables(files, tolerant)
        k = t["keys"].where("path <> ''").withColumn("last_write", c.filetime_to_micros("last_write_ft"))
        return Tree(_keys(k), _values(t["values"]), t)

    @staticmethod
    def from_ops(ops: DataFrame) -> Tree:
        """A tree that a log makes from nothing."""
        k = apply.live_keys(ops).withColumn("last_write", F.lit(0).cast("long"))
        v = apply.live_values(ops, _FIELDS).withColumnRenamed("path", "key_path")
        return Tree(_keys(k), _values(v))

    @staticmethod
    def from_reg(spark: SparkSession, *paths: str, **how) -> Tree:
        return Tree.from_ops(regtext.read(spark, *paths, **how))

    # ---- lookup

    def info(self) -> DataFrame:
        """Header fields of the images."""
        if self.image is None:
            raise ValueError("this tree came from no image")
        h = self.image["hives"]
        return h.withColumns({"last_write": c.filetime_to_micros("last_write_ft"), "clean": F.col("primary_seq") == F.col("secondary_seq"), "checksum_ok": F.col("checksum_stored") == F.col("checksum_calc")})

    def find(self, path: str) -> DataFrame:
        return read.find(self.keys, path)

    def list_keys(self, path: str = "", recursive: bool = True, max_depth: int | None = None) -> DataFrame:
        return read.list_keys(self.keys, path, recursive, max_depth).orderBy("path")

    def list_values(self, path: str) -> DataFrame:
        return read.list_values(self.values, path).orderBy("name")

    def get(self, path: str, name: str = "") -> DataFrame:
        v = read.get_value(self.values, path, name)
        return v.withColumns(c.decode_value("reg_type", "data")).withColumn("shown", c.display("reg_type", "data"))

    def stat(self) -> DataFrame:
        return read.with_counts(self.keys, self.values)

    def search(self, text: str, **how) -> tuple[DataFrame, DataFrame]:
        shown = self.values.withColumns(c.decode_value("reg_type", "data"))
        return search.search_keys(self.keys, text, **how), search.search_values(shown, text, **how)

    def filter(self, text: str) -> DataFrame:
        return search.filter_tree(self.keys, text)

    def stats(self) -> dict[str, DataFrame]:
        return {
            "totals": stats.totals(self.keys, self.values),
            "levels": stats.by_level(self.keys),
            "types": stats.by_type(self.values),
            "sizes": stats.size_buckets(self.values),
            "largest_key": stats.largest_key(self.keys),
            "largest_value": stats.largest_value(self.values),
        }

    def cells(self) -> dict[str, DataFrame]:
        """Counts of cells by kind and use, space per image, and the emptiest bins."""
        if self.image is None:
            raise ValueError("this tree came from no image")
        cells, bins = self.image["cells"], stats.bin_use(self.image["hbins"], self.image["cells"])
        return {"kinds": stats.cell_counts(cells), "purposes": stats.cells_by_use(cells, self.image["refs"]), "storage": stats.storage(cells), "worst_bins": bins.orderBy("efficiency", "hive_id", "abs_off").limit(20), "classes": stats.efficiency_classes(bins), "summary": stats.bin_summary(bins)}

    def layout(self) -> tuple[DataFrame, DataFrame]:
        """Sizes of key and value records: names as stored, and the records they make."""
        if self.image is None:
            raise ValueError("this tree came from no image")
        width = F.when(F.col("name_compressed"), F.char_length("name")).otherwise(2 * F.char_length("name"))
        k = self.image["keys"].select("hive_id", "path", width.alias("name_bytes"), (4 + 0x4C + width).alias("record"), c.align(4 + 0x4C + width, 8).alias("cell"))
        v = self.image["values"].select("hive_id", "key_path", "name", width.alias("name_bytes"), (24 + width).alias("record"), c.align(24 + width, 8).alias("cell"), F.when(F.col("inline"), "inline").when(F.col("size") <= regf.CHUNK, "cell").otherwise("blocks").alias("storage"))
        return k, v

    # ---- change

    def ops(self) -> DataFrame:
        return apply.snapshot_ops(self.keys, self.values, _FIELDS, F.lit(0).cast("long"))

    def merge(self, log: DataFrame) -> Tree:
        """The tree after a log; its seq may be of any comparable type."""
        base = self.ops().select(F.struct(F.lit(0).alias("part"), F.lit(None).cast(log.schema["seq"].dataType).alias("seq")).alias("seq"), "op", "path", "path_norm", "name", *_FIELDS)
        new = log.select(F.struct(F.lit(1).alias("part"), F.col("seq").alias("seq")).alias("seq"), "op", "path", "path_norm", "name", *_FIELDS)
        out = Tree.from_ops(base.unionByName(new))
        known = self.keys.select("path_norm", F.col("last_write").alias("_w"))
        out.keys = out.keys.drop("last_write").join(known, "path_norm", "left").withColumn("last_write", F.coalesce("_w", F.lit(0))).drop("_w")
        return out

    def merge_reg(self, *paths: str, prefix: str | None = None, **how) -> Tree:
        log = regtext.read(self.keys.sparkSession, *paths, **how)
        return self.merge(oplog.with_prefix(log, prefix) if prefix else log)

    def _one(self, op: str, path: str, name: str | None = None, kind: str | None = None, text: str | None = None) -> Tree:
        row = self.keys.sparkSession.createDataFrame([(1, op, path, name, kind, text)], "seq long, op string, raw string, name string, kind string, text string")
        typed = {"path": c.clean_path("raw"), "path_norm": c.norm_path("raw"), "reg_type": c.type_code("kind"), "data": oplog.parse_value("text", "kind") if text is not None else F.lit(None).cast("binary")}
        return self.merge(row.withColumns(typed))

    def set(self, path: str, name: str, kind: str, text: str) -> Tree:
        return self._one(SET, path, name, kind, text)

    def create_key(self, path: str) -> Tree:
        return self._one(CREATE, path)

    def delete_key(self, path: str, recursive: bool = False) -> Tree:
        if not read.can_delete(self.keys, path, recursive).first()["allowed"]:
            raise ValueError(f"{path} has subkeys; delete it with recursive=True")
        return self._one(DELETE_KEY, path)

    def delete_value(self, path: str, name: str) -> Tree:
        return self._one(DELETE_VALUE, path, name)

    def link(self, child: Tree, mount: str, conflict: str = link.OVERWRITE, flatten: str | None = None) -> Tree:
        k = link.link_keys(self.keys, link.mounted(child.keys.select("path"), "path", mount, flatten))
        k = k.join(self.keys.select("path", "last_write"), "path", "left").withColumn("last_write", F.coalesce("last_write", F.lit(0).cast("long")))
        cols = ["key_path", "name", *_FIELDS]
        v = link.link_values(self.values.select(cols), link.mounted(child.values.select(cols), "key_path", mount, flatten), conflict)
        return Tree(_keys(k), _values(v))

    # ---- compare and check

    def diff(self, new: Tree) -> tuple[DataFrame, DataFrame]:
        vd = diff.diff_values(self.values, new.values)
        return diff.diff_keys(self.keys, new.keys, vd), vd

    def validate(self, limits: Limits | None = None) -> DataFrame:
        return checks.validate(self.keys, self.values, limits or Limits())

    def verify(self) -> DataFrame:
        if self.image is None:
            raise ValueError("this tree came from no image")
        return checks.verify(*(self.image[x] for x in ("hives", "hbins", "cells")))

    def diagnose(self) -> DataFrame:
        if self.image is None:
            raise ValueError("this tree came from no image")
        return checks.diagnose(*(self.image[x] for x in ("hives", "hbins", "cells", "keys", "refs", "errors", "values")))

    def security(self) -> DataFrame:
        """Security records with the counts they store and the keys that refer to them."""
        if self.image is None:
            raise ValueError("this tree came from no image")
        return checks.security_counts(self.image["security"], self.image["refs"])

    # ---- sinks

    def write_reg(self, path: str, root: str = "HKEY_LOCAL_MACHINE") -> None:
        regtext.write(self.keys, self.values, path, root)

    def images(self, name: str = "hive") -> DataFrame:
        """hive_id and image: the tree written anew, which also leaves out free space."""
        return hivewriter.write(self.keys.withColumn("hive_id", F.lit(name)), self.values.withColumn("hive_id", F.lit(name)))

    def json(self) -> DataFrame:
        return export.json_keys(self.keys, self.values)

    def text(self, max_depth: int | None = None) -> DataFrame:
        return export.text_tree(self.keys, max_depth)


def _keys(df: DataFrame) -> DataFrame:
    return df.select("path", c.norm_path("path").alias("path_norm"), c.parent("path").alias("parent_path"), c.last_part("path").alias("name"), c.depth("path").alias("depth"), "last_write")


def _values(df: DataFrame) -> DataFrame:
    return df.select("key_path", c.norm_path("key_path").alias("key_norm"), "name", F.col("reg_type").cast("int").alias("reg_type"), F.coalesce(F.octet_length("data"), F.lit(0)).cast("long").alias("size"), "data")
