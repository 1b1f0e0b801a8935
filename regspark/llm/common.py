"""What the operators share: reading tables, Arrow maps and materialised steps."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch; whole texts make a row of documents some kilobytes.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="regspark-")
        spark.sparkContext.setCheckpointDir(d)
    return d


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again, which cuts its lineage.

    The files go when the process ends; they survive the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/regspark-steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns what this process has freed to the system: workers wait for further tasks, the driver for its stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def map_arrow(df: DataFrame, f, schema) -> DataFrame:
    """mapInArrow in batches of few rows, as the rows hold whole texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n
