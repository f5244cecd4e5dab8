"""Cutting lineage in iterative operators, and tables kept for a while."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share. Only a local session without that setting gets one of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cloudloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder. With spark.cleaner.referenceTracking.cleanCheckpoints Spark deletes it
    once nothing refers to it."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class kept:
    """``with kept(df) as table``: df written to the shared folder once, read as often as need be, deleted at the end."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __enter__(self) -> DataFrame:
        spark = self.df.sparkSession
        self.path = f"{shared_folder(spark)}/cloudloom/{uuid.uuid4().hex}"
        self.df.write.parquet(self.path)
        return spark.read.schema(self.df.schema).parquet(self.path)

    def __exit__(self, *problem: object) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Stages:
    """A table that steps replace one after the other: each is written to the shared folder, packed by columns, before the one before it is deleted.

    Whatever was made of the stage before must be in the new one. The last one stays.
    """

    def __init__(self, df: DataFrame):
        self.now, self.held = df, None

    def put(self, df: DataFrame) -> DataFrame:
        before, self.held = self.held, kept(df)
        self.now = self.held.__enter__()
        if before is not None:
            before.__exit__()
        return self.now


def bounded(df: DataFrame, rows: int = 1 << 17) -> DataFrame:
    """A narrow table for a join: broadcast if it has at most so many rows, counted now; else joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
