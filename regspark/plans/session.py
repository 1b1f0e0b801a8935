"""Sessions over a stored tree: changes are collected, committed as a new version, or rolled back.

A store is a folder with one folder for each version, `v=N`, that holds `keys`,
`values` and the `log` that led to it. A version is there once its `done` marker
is, which is written last; a session that dies leaves no version. Earlier versions
stay, so any of them can be read or made current again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..api import Tree
from ..operators import oplog


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, store: str) -> list[int]:
    """The committed versions, in order."""
    fs, p = _fs(spark, store)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(_fs(spark, f"{store}/{n}/done")[1]))


def open_version(spark: SparkSession, store: str, version: int | None = None) -> Tree:
    """The tree of a version, the latest by default."""
    n = versions(spark, store)[-1] if version is None else version
    return Tree(spark.read.parquet(f"{store}/v={n}/keys"), spark.read.parquet(f"{store}/v={n}/values"))


def create(tree: Tree, store: str, log: DataFrame | None = None) -> int:
    """Writes a tree as the next version."""
    spark = tree.keys.sparkSession
    n = (versions(spark, store) or [0])[-1] + 1
    tree.keys.write.mode("overwrite").parquet(f"{store}/v={n}/keys")
    tree.values.write.mode("overwrite").parquet(f"{store}/v={n}/values")
    if log is not None:
        log.write.mode("overwrite").parquet(f"{store}/v={n}/log")
    fs, p = _fs(spark, f"{store}/v={n}/done")
    fs.create(p, True).close()
    return n


@dataclass
class Session:
    """Changes on top of a version; nothing is seen by others before commit()."""

    spark: SparkSession
    store: str
    base: int
    logs: list[DataFrame] = field(default_factory=list)

    @staticmethod
    def begin(spark: SparkSession, store: str) -> Session:
        return Session(spark, store, versions(spark, store)[-1])

    def apply(self, log: DataFrame) -> Session:
        """Adds operations after those so far; their seq must be of one type."""
        self.logs.append(log.select("seq", "op", "path", "path_norm", "name", "reg_type", "data"))
        return self

    def log(self) -> DataFrame:
        return oplog.concat_logs(*self.logs)

    def preview(self) -> Tree:
        """The tree as it would be committed."""
        tree = open_version(self.spark, self.store, self.base)
        return tree.merge(self.log()) if self.logs else tree

    def commit(self) -> int:
        """Writes the next version; another session's commit since begin() is not overwritten but refused."""
        if versions(self.spark, self.store)[-1] != self.base:
            raise ValueError("another session has committed; begin again")
        self.base = create(self.preview(), self.store, self.log() if self.logs else None)
        self.logs = []
        return self.base

    def rollback(self) -> None:
        """Forgets the changes since begin() or the last commit."""
        self.logs = []


def restore(spark: SparkSession, store: str, version: int) -> int:
    """Makes an earlier version's content the latest."""
    return create(open_version(spark, store, version), store)
