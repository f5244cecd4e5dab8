"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed by the contract: a word is a run of anything but space and U+0009-U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    On a cluster it is named by ``spark.checkpoint.dir``. Only where that is unset (a local
    session, as in tests) a folder of our own is made.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="cloudloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cloudloom/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cloudloom_path = path
    return out


def bounded(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """A narrow table of a few numbers a row, for a join: broadcast if it has at most so many rows, counted now; else joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def discard(df: DataFrame | None) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_cloudloom_path", None)
    if path:
        drop_folder(df.sparkSession, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own in the shared one."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def tidy() -> None:
    """Give free memory of this worker back: workers stay for the next stage, and what they hold on to is missing there."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def spare(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Words in a text; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
