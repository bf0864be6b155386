"""Snippets that arrive as a stream: normalized, fingerprinted, and counted per content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize


def snippets(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def fingerprints(stream: DataFrame) -> DataFrame:
    """``id, norm_md5, chars``; stateless."""
    return normalize.normalized(stream).select("id", F.md5("norm_text").alias("norm_md5"), F.length("norm_text").cast("long").alias("chars"))


def copies(stream: DataFrame) -> DataFrame:
    """Per normalized content so far: its smallest id and how many snippets have it; for update or complete output."""
    return fingerprints(stream).groupBy("norm_md5").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))


def first_seen(stream: DataFrame, time_column: str, delay: str) -> DataFrame:
    """The first snippet of each content within the watermark; state of older content is dropped."""
    own = stream.withWatermark(time_column, delay)
    return normalize.normalized(own).withColumn("norm_md5", F.md5("norm_text")).dropDuplicatesWithinWatermark(["norm_md5"])
