"""Streams of documents and triples: an extension, as the batch operators are what is to be matched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def documents(spark: SparkSession, path: str, schema, glob: str = "*", max_files: int = 16) -> DataFrame:
    """New files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", glob).parquet(path)


def once(df: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Rows of each key once within the time that late ones are waited for."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, time: str = "ts", by: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling window; a window is final when the watermark has passed it."""
    w = events.withWatermark(time, late).groupBy(F.window(time, size), by)
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def into(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each micro-batch through a batch function; a batch that is repeated after a failure has the same number."""
    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_clusters(triples: DataFrame) -> DataFrame:
    """Running support of triples ``(predicate, head, tail)``, for output in update mode: one state per key, of fixed size."""
    return triples.groupBy("predicate", "head", "tail").agg(F.count("*").alias("support"))
