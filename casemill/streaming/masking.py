"""Masking and category counts of case texts that arrive as a stream.

All rules are projections of one row, so they run unchanged on a stream; draws are keyed by the row's
key. Late and repeated loads are dropped by key within a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators.mask import MaskingConfig, masked_dataset
from casemill.session import shared_path


def masked_stream(stream: DataFrame, text: str, key: str, config: MaskingConfig = MaskingConfig(), event_time: str | None = None, watermark: str = "30 days") -> DataFrame:
    """The masked dataset of a stream of cases. With ``event_time``, repeated loads of a key within the watermark are dropped."""
    if event_time:
        stream = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([key])
    return masked_dataset(stream, text, key, config)


def windowed_counts(stream: DataFrame, event_time: str, types: str = "mask_types", window: str = "1 day", watermark: str = "30 days") -> DataFrame:
    """Masks by type and time window; late rows within the watermark are still counted."""
    at = F.col(event_time).cast("timestamp")
    masks = stream.withColumn(event_time, at).withWatermark(event_time, watermark).select(event_time, F.explode(F.split(types, "; ")).alias("mask_type"))
    return masks.groupBy(F.window(event_time, window).alias("w"), "mask_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "mask_type", "n")


def mask_files_once(spark: SparkSession, path: str, text: str, key: str, config: MaskingConfig = MaskingConfig()) -> DataFrame:
    """All files under ``path`` masked by a stream that ends when they are done; exactly once, with a durable checkpoint."""
    import os

    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name if os.path.isfile(path) else "*.parquet").parquet(folder if os.path.isfile(path) else path)
    out = shared_path(spark, "stream")
    query = masked_stream(stream, text, key, config).select("source_row_id", "masked_text", "masked_token_count", "mask_types").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
