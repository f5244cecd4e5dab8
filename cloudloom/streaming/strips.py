"""Streams of points and of timing events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.tiling import TileGrid


def arriving(spark: SparkSession, folder: str, schema: StructType | str, files: int = 16) -> DataFrame:
    """Points of Parquet files as they appear in a folder, at most so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def append_tiles(points: DataFrame, grid: TileGrid, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each batch appended to a table partitioned by tile. A batch that is run again replaces what it wrote, so no point is there twice."""
    tiled = points.withColumn("tile", grid.index())

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).repartition("tile").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "tile").parquet(target)

    stream = tiled.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def step_times(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Count and mean duration of each step in windows of event time (moment); events later than the watermark are left out."""
    own = events.withWatermark("moment", late).groupBy(F.window("moment", window), "step")
    return own.agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("mean")).select("window.start", "window.end", "step", "n", "mean")


def without_repeats(events: DataFrame, keys: list[str], late: str = "30 minutes") -> DataFrame:
    """Events once each, as far back as the watermark reaches."""
    return events.withWatermark("moment", late).dropDuplicatesWithinWatermark(keys)


def each_batch(points: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Any batch operator over a stream, a batch at a time."""
    return points.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
