"""Repairs of hive images: few-byte patches that are planned, checked and applied."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.regf import HEADER_SIZE, RECORD_FIELDS, checksum, contents, image_batch
from .checks import auto_repairable


def plan(diagnostics: DataFrame, max_risk: str = "low") -> DataFrame:
    """hive_id, offset, kind and expected value of the repairs that may run; the checksum is last."""
    d = auto_repairable(diagnostics, max_risk)
    return d.select("hive_id", "offset", F.col("repair.type").alias("kind"), F.col("expected").cast("long").alias("value")).orderBy("hive_id", F.col("kind") == "checksum", "offset")


def patch(image: bytes | memoryview, repairs: list[tuple[int, str, int]]) -> tuple[bytes | bytearray | memoryview, list[str]]:
    """The image with 4-byte patches, and a log. A patch outside the image, or of a field whose record is not there, undoes all."""
    data, log = bytearray(image), []
    for off, kind, value in sorted(repairs, key=lambda r: r[1] == "checksum"):
        at, new = {"sequence": (8, struct.unpack_from("<I", data, 4)[0]), "checksum": (508, None), "hbin_offset": (off, value)}.get(kind, (None, None))
        if kind in RECORD_FIELDS:
            sig, field = RECORD_FIELDS[kind]
            if off - field >= HEADER_SIZE and data[off - field : off - field + 2] == sig:
                at, new = off, value
        if kind == "checksum":
            new = checksum(bytes(data[:4096]))
        if at is None or at + 4 > len(data):
            return image, [*log, f"{kind} at {off}: not possible, all undone"]
        struct.pack_into("<I", data, at, new)
        log.append(f"{kind} at {at}: {new}")
    if repairs:  # the header changed, so did its sum
        struct.pack_into("<I", data, 508, checksum(bytes(data[:4096])))
    return data, log


def safe(repairs: DataFrame, files: DataFrame) -> DataFrame:
    """Adds `safe`: the patch lies inside the image, is aligned, no other patch of the image touches its four bytes, and a field's record is where it should be."""
    image, r = F.col("_content"), F.col("_r")
    kind, offset = r["kind"], r["offset"]
    at = F.when(kind == "sequence", 8).when(kind == "checksum", 508).otherwise(offset)
    here = F.lit(True)
    for name, (sig, field) in RECORD_FIELDS.items():
        start = (offset - field).cast("int")
        here = F.when(kind == name, (start >= HEADER_SIZE) & (image.substr(start + 1, F.lit(2)) == F.lit(sig))).otherwise(here)
    fits = (at >= 0) & (at + 4 <= F.octet_length("_content")) & (at % 4 == 0)
    # an image meets its repairs once, not once for each, and goes no further than this join
    per = repairs.groupBy("hive_id").agg(F.collect_list(F.struct(*repairs.columns)).alias("_todo"))
    j = per.join(files.select("hive_id", F.col("content").alias("_content")), "hive_id", "left")
    met = j.select("_content", F.explode("_todo").alias("_r")).select("_r.*", at.alias("_at"), (fits & here).alias("_fits"))
    same = met.groupBy("hive_id", "_at").agg(F.count("*").alias("_n"), F.collect_list(F.struct(*repairs.columns, "_fits")).alias("_rs"))
    return same.select(F.explode("_rs").alias("_r"), "_n").select(*(F.col("_r")[x].alias(x) for x in repairs.columns), F.coalesce(F.col("_r._fits") & (F.col("_n") == 1), F.lit(False)).alias("safe"))


def untouched(before: bytes, after: bytes, places: list[int]) -> bool:
    """Nothing but the four bytes at each place has changed."""
    if len(before) != len(after):
        return False
    one, two = bytearray(before), bytearray(after)
    for at in places:
        one[at : at + 4] = two[at : at + 4] = b"\0" * 4
    return one == two


#: An image under this size is no whole image.
LEAST_IMAGE = 4096


def backup(files: DataFrame, store: str, label: str) -> None:
    """Keeps the images of `files` (hive_id, content) under a label, with their sums."""
    files.select("hive_id", "content", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("sum")).write.mode("errorifexists").parquet(f"{store}/label={label}")


def backups(spark, store: str) -> DataFrame:
    """label, hive_id, size and valid of all that is kept: large enough, with a header, and as it was when kept."""
    b = spark.read.parquet(store)
    valid = (F.col("size") >= LEAST_IMAGE) & (F.substring("content", 1, 4) == F.lit(b"regf")) & (F.sha2("content", 256) == F.col("sum"))
    return b.select(F.col("label").cast("string").alias("label"), "hive_id", "size", valid.alias("valid"))


def restore(spark, store: str, label: str) -> DataFrame:
    """hive_id and content as kept under a label."""
    return spark.read.parquet(f"{store}/label={label}").select("hive_id", "content")


def apply(files: DataFrame, repairs: DataFrame, dry_run: bool = False) -> DataFrame:
    """files: hive_id, content. hive_id, content after the repairs, and the log."""
    per = repairs.groupBy("hive_id").agg(F.collect_list(F.struct("offset", "kind", "value")).alias("todo"))

    def run(batches):
        for b in batches:
            for (hive, content), todo in zip(contents(b), b.column(2), strict=True):
                got, log = patch(content, [(x["offset"], x["kind"], x["value"]) for x in todo.as_py() or []])
                yield image_batch(["hive_id", "content", "log"], hive, content if dry_run else got, pa.array([log], pa.list_(pa.string())))
                del got

    return files.select("hive_id", "content").join(per, "hive_id", "left").mapInArrow(run, "hive_id string, content binary, log array<string>")
