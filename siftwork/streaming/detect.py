"""Detection over streams: documents or chunks arrive as files, findings are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.operators import detect


def documents_stream(spark: SparkSession, path: str, schema: str | T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def counts_stream(docs: DataFrame, keys: list[str], text: str = "text", detectors: list[str] | None = None, clean: bool = True) -> DataFrame:
    """keys + (pattern_name, value, count) in update or complete mode: the state is one number per distinct finding."""
    m = detect.matches(docs.select(*keys, text), text, detectors, clean)
    return m.groupBy(*keys, "pattern_name", "value").agg(F.count("*").alias("count"))


def windowed_counts(docs: DataFrame, at: str, late: str = "7 days", length: str = "1 day", text: str = "text", detectors: list[str] | None = None) -> DataFrame:
    """Matches by window of event time; rows later than `late` behind the newest are dropped by the watermark and the state is freed."""
    m = detect.matches(docs.withWatermark(at, late).select(at, text), text, detectors, clean=True)
    return m.groupBy(F.window(at, length), "pattern_name").agg(F.count("*").alias("count")).select(F.col("window.start").alias("window_start"), "pattern_name", "count")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Processes what is there and gives the result table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
