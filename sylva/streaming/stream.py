"""Queries over streams of texts: shredding and pointer filters are stateless, so they run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.edit import pointer_get
from ..operators.shred import shred


def stream_table(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def stream_pointer(texts: DataFrame, key: str, text: str, pointer: str) -> DataFrame:
    """A pointer's value in every arriving document; texts that do not parse leave no row."""
    return pointer_get(shred(texts, key, text, "DROPMALFORMED"), pointer)


def windowed_counts(texts: DataFrame, ts: str, key: str, text: str, pointer: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of a pointer's values by event-time window; the key column carries the time through shredding."""
    keyed = texts.withWatermark(ts, late).withColumn("_key", F.struct(F.col(ts).alias("ts"), F.col(key).alias("id")))
    got = stream_pointer(keyed, "_key", text, pointer)
    return got.groupBy(F.window("doc_key.ts", size), "json").agg(F.count("*").alias("n"))
