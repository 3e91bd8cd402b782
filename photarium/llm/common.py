"""What several operators share: the shared folder, stored intermediates and row identity."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as Java and DuckDB regular expressions write its complement.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset, and all runs in one process, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        root = context.getCheckpointDir()
        if not root:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="photarium-"))
            root = context.getCheckpointDir()
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: small iterative state, whose lineage would grow with every round."""
    spark = df.sparkSession
    root = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch of texts. A worker holds a batch several times over: as Arrow, as strings, as ids, and as results.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df itself. Its session sends texts to Python in batches of BATCH_BYTES from now on, unless it has a setting of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, "67108864b").rstrip("b") == "67108864":
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def tidied(results: Iterator) -> Iterator:
    """The results, and after them the worker's free memory goes back to the system: workers outlive their tasks, idle ones too."""
    try:
        yield from results
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass


_stored: list[str] = []


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it back; columnar and compressed, so cheaper than a checkpoint for wide rows.

    The folder lives as long as the driver, since lazy results may read it; drop() removes it sooner.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    if not _stored:
        atexit.register(_drop_all)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _stored.append(path)
    return path


def drop(df: DataFrame) -> None:
    """Delete what store() wrote. Nothing may read the frame afterwards."""
    path = df._stored_at
    _delete(df.sparkSession, path)
    if path in _stored:
        _stored.remove(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files that no plan reaches any more, instead of when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_stored):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before us; the folder's owner cleans up
            return


def row_ids(names: tuple[str, str] = ("rid", "rid2")) -> list[Column]:
    """A row's identity by doc_id and text where doc_id may be null or repeated, in two columns that hold 128 bits: equal for equal rows only."""
    return [F.xxhash64("doc_id", "text").alias(names[0]), F.xxhash64(F.lit(1), "text", "doc_id").alias(names[1])]
