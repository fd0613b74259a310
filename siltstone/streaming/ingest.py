"""Streams: resumable ingest of files and bounded-state duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ingest_new_files(spark: SparkSession, source: str, schema: StructType | str, pipeline: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, fmt: str = "parquet", files_per_batch: int = 1000) -> None:
    """Runs the pipeline over files that no earlier call has seen and appends to ``sink``, exactly once. For stages that
    look at rows one by one; corpus-wide stages belong in a batch job."""
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(source)
    q = pipeline(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def first_seen(stream: DataFrame, key: str, time: str, keep: str = "7 days") -> DataFrame:
    """The first row of each key within ``keep``: state is dropped when the watermark passes, so that it stays bounded."""
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def text_rates(stream: DataFrame, time: str, flag: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and flagged rows by event-time window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(flag)).alias("flagged"))
