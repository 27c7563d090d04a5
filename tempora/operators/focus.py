"""Asking an index: ranges worth a closer look, and their frames read again at a higher rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions import exprs
from tempora.operators import evaluate, intervals, sequences
from tempora.schema import MotionConfig


def ranges(asr: DataFrame, ocr: DataFrame, attention: DataFrame, keywords: list[str] | None = None, attention_only: bool = False) -> DataFrame:
    """(video_id, start_t, end_t, n): attention windows, and with keywords the speech and text that have one, merged over gaps of 10 s."""
    matches = exprs.contains_any(F.col("text"), keywords) if keywords and not attention_only else F.lit(False)
    return evaluate.candidate_ranges(asr, ocr, attention, matches)


def frames_within(frames: DataFrame, wanted: DataFrame, every: int = 1, width: float = 60.0) -> DataFrame:
    """Each range's frames (both ends in), of these the first and each ``every``-th after it; a frame in two ranges comes for both.

    The columns of ``frames`` with start_t and end_t; the time bounds of ranges reach the join, not a scan of each range.
    """
    met = intervals.interval_join(wanted.select("video_id", "start_t", "end_t"), frames, lo="start_t", hi="end_t", at="t", width=width)
    order = Window.partitionBy("video_id", "start_t", "end_t").orderBy("t", "seq")
    return met.withColumn("_k", F.row_number().over(order) - 1).where(F.col("_k") % every == 0).drop("_k")


def focused(frames: DataFrame, wanted: DataFrame, config: MotionConfig = MotionConfig(), fps: float = 30.0, width: float = 60.0) -> DataFrame:
    """Keyframes (video_id, start_t, end_t, seq, t, reason) of each range by itself, looked for at twice the usual rate.

    ``frames`` has what the keyframe lanes take: seq, t, grey, phash, hist, motion.
    """
    every = max(1, int(fps / (2 * config.keyframe_hz)))
    kept = frames_within(frames, wanted, every, width)
    one = F.struct("video_id", "start_t", "end_t")
    inner = kept.withColumn("_key", F.to_json(one)).drop("video_id", "start_t", "end_t").withColumnRenamed("_key", "video_id")
    found = sequences.accept_keyframes(inner, config, key="string")
    back = F.from_json("video_id", f"video_id {frames.schema['video_id'].dataType.simpleString()}, start_t double, end_t double")
    return found.withColumn("_r", back).select("_r.*", "seq", "t", "reason")


def query_index(spark: SparkSession, path: str, frames: DataFrame | None = None, keywords: list[str] | None = None, attention_only: bool = False) -> dict[str, DataFrame]:
    """``ranges`` of an index document, and ``focused`` keyframes if there are frames to read again (video_id 0)."""
    from tempora.sources import readers

    tables = readers.index_json(spark, path)
    wanted = {"asr": ("t", "end_t", "text"), "ocr": ("t", "text"), "attention_windows": ("t", "end")}
    parts = {}
    for name, columns in wanted.items():
        d = tables.get(name)
        have = d.columns if d is not None else []
        d = d if d is not None else spark.range(0).drop("id")
        fields = [(F.col(c) if c in have else F.lit(None)).cast("string" if c == "text" else "double").alias(c) for c in columns]
        parts[name] = d.select(F.lit(0).cast("long").alias("video_id"), F.monotonically_increasing_id().alias("seq"), *fields)
    found = ranges(parts["asr"], parts["ocr"], parts["attention_windows"], keywords, attention_only)
    return {"ranges": found} | ({"focused": focused(frames, found)} if frames is not None else {})
