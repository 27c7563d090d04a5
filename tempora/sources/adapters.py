"""Driver tables as canonical timelines (see SURVEY §7.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The event type that each source type stands for.
TYPES = {"signup": "asr", "click": "motion", "error": "motion_end", "view": "keyframe", "purchase": "ocr"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, seq, t, type, score): a user's events, seconds since 2024-01-01."""
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("seq"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1e6D").alias("t"),
        kind[F.col("event_type")].alias("type"),
        F.col("value").alias("score"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, seq, t, text): conversation turns, one each 15 seconds."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("seq"), (F.col("turn") * F.lit(15.0)).alias("t"), "text"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, seq, t, v): embeddings in order of id, one timeline a label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("video_id"), F.col("vec_id").alias("seq"), F.col("vec_id").cast("double").alias("t"), F.col("embedding").alias("v")
    )
