"""Streams: watching source files, and bursts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

DEBOUNCE = "500 milliseconds"


def watch(spark: SparkSession, root: str, run: Callable[[DataFrame, int], None], checkpoint: str, debounce: str = DEBOUNCE, suffix: str = ".rs") -> StreamingQuery:
    """Calls run(changed files, batch) at most once per debounce interval with the (path, content) of new files under root. What run does with them, a full analysis or the changed files only, is its own affair."""
    files = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").schema("value string").text(root, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return named.writeStream.foreachBatch(lambda df, n: run(df, n)).option("checkpointLocation", checkpoint).trigger(processingTime=debounce).start()


def bursts(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Events of a key no further apart than the gap as one burst: key, first, last, n. Works on streams and tables; late events are dropped beyond `late` on streams only."""
    e = events.withColumn("_at", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("_at", late)
    g = e.groupBy(F.col(key), F.session_window("_at", gap)).agg(F.count("*").alias("n"), F.min("_at").alias("first"), F.max("_at").alias("last"))
    return g.select(key, "first", "last", "n")


def event_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
