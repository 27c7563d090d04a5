"""Canonical tables and thresholds of the timeline engine.

Every table has ``video_id``: one timeline. Time ``t`` is seconds as a double on that timeline, ``seq`` is the
source order, which breaks ties wherever order matters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("video_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("t", T.DoubleType()),
    T.StructField("type", T.StringType()),
    T.StructField("score", T.DoubleType()),
])
SEGMENTS = T.StructType([
    T.StructField("video_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("t", T.DoubleType()),
    T.StructField("end_t", T.DoubleType()),
    T.StructField("text", T.StringType()),
])


@dataclass(frozen=True)
class MotionConfig:
    """Confirmation and length of motion segments, and the gates of the keyframe lanes."""

    confirm_frames: int = 3
    min_segment: float = 0.5
    keyframe_hz: float = 1.0
    change_threshold: float = 10.0
    phash_distance: int = 12
    hist_correlation: float = 0.5
    dedup_distance: int = 5
    dedup_last: int = 5
    drift_window: int = 5
    drift_confirm: int = 3
    soft_window: float = 30.0
    soft_ratio: float = 0.6
    soft_checks: int = 2
    force_factor: float = 3.0


@dataclass(frozen=True)
class AlignConfig:
    tail: float = 2.0
    attention_gap: float = 5.0
    range_gap: float = 10.0
    band: float = 15.0
    hint_similarity: float = 0.6


@dataclass(frozen=True)
class SelectConfig:
    interval: float = 30.0
    k: int = 1
    grow_below: float = 3.0
    shrink_above: float = 20.0
    pixel_weight: float = 0.5
