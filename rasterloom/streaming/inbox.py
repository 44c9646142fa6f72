"""A file inbox of images as a stream (an extension): each new image goes through the batch pipeline once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterloom.functions.paths import is_tiff_path


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, bytes, arrived) of the image files that turn up in ``folder``; their content isn't read."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("arrived")).where(is_tiff_path(F.col("path")))


def start(spark: SparkSession, folder: str, segment: Callable[[str], str], checkpoint: str, results: str) -> StreamingQuery:
    """Run ``segment`` on every image once all that is there is worked off, noting (path, mask) rows below ``results``.

    Batch and path name a result, so a batch that is run again after a failure overwrites its own rows.
    """

    def batch(df: DataFrame, number: int) -> None:
        done = [(r["path"], segment(r["path"].replace("file://", "").replace("file:", ""))) for r in df.select("path").collect()]
        if done:
            spark.createDataFrame(done, "path string, mask string").coalesce(1).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return arrivals(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Images and bytes per window of arrival; windows close when the watermark has passed them."""
    return stream.withWatermark("arrived", late).groupBy(F.window("arrived", size)).agg(F.count(F.lit(1)).alias("images"), F.sum("bytes").alias("bytes"))
