"""Ordered-sequence operators: sessions, keyframe acceptance, deduplication, tails, budgets.

What a window can express is one; what depends on its own earlier decisions is a step function, folded over
each timeline in one grouped pass here and over state in the stream, so that both give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import asdict
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.fold import Steps, folded
from tempora.schema import MotionConfig


def _order():
    return Window.partitionBy("video_id").orderBy("t", "seq")


def _so_far():
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def _trailing(call: str, seconds: float) -> Column:
    return F.expr(f"{call} OVER (PARTITION BY video_id ORDER BY t RANGE BETWEEN {float(seconds)!r}D PRECEDING AND CURRENT ROW)")


def motion_segments(frames: DataFrame, config: MotionConfig = MotionConfig()) -> DataFrame:
    """Segments of frames (video_id, seq, t, boxes: number of regions, gated: large enough, ratio).

    A frame without boxes ends what is open. Gated frames in unbroken succession confirm a segment at the
    ``confirm_frames``-th; small frames break the succession but neither extend nor end an open segment.
    Every closed segment is given, with ``kept`` true if it is long enough.
    """
    closes = (F.col("boxes") == 0).cast("int")
    ruled = frames.withColumn("_open", F.coalesce(F.sum(closes).over(_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ruled = ruled.withColumn("_small", F.sum((~F.col("gated")).cast("int")).over(_so_far()))
    run = Window.partitionBy("video_id", "_open", "_small").orderBy("t", "seq")
    live = F.col("gated") & (F.col("boxes") > 0)
    ruled = ruled.withColumn("_streak", F.sum(live.cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("video_id", "_open").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    ruled = ruled.withColumn("_confirmed", F.max((live & (F.col("_streak") >= config.confirm_frames)).cast("int")).over(inside))
    part = F.col("_confirmed").cast("boolean") & live
    found = ruled.groupBy("video_id", "_open").agg(
        F.min(F.when(part, F.col("t"))).alias("start_t"), F.max(F.when(part, F.col("t"))).alias("end_t"),
        F.max(F.when(part, F.col("ratio"))).alias("max_ratio"), F.min(F.when(F.col("boxes") == 0, F.col("t"))).alias("closed_t"),
    ).where("start_t is not null")
    return found.select("video_id", "start_t", "end_t", "max_ratio", "closed_t", (F.col("end_t") - F.col("start_t") >= config.min_segment).alias("kept"))


def segment_anchors(segments: DataFrame, keyframes: DataFrame, width: float = 3600.0) -> DataFrame:
    """Closed segments that hold no keyframe in [start_t, closed_t): each gives an anchor at its close."""
    closed = segments.where("closed_t is not null")
    spread = closed.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_t") / width), F.floor(F.col("closed_t") / width))))
    k = keyframes.select(F.col("video_id").alias("_v"), F.col("t").alias("_t"), F.floor(F.col("t") / width).alias("_kb"))
    on = (F.col("video_id") == F.col("_v")) & (F.col("_b") == F.col("_kb")) & (F.col("_t") >= F.col("start_t")) & (F.col("_t") < F.col("closed_t"))
    covered = spread.join(k, on, "left_semi").select("video_id", "start_t").distinct()
    return closed.join(covered, ["video_id", "start_t"], "left_anti").select("video_id", F.col("closed_t").alias("t"), F.lit("segment_anchor").alias("reason"))


class KeyframeState:
    """What a timeline's keyframe lanes remember; ``step`` takes one frame and returns a reason or None.

    A frame is a small grey picture (any sequence of numbers), its perceptual hash, its histogram, and whether there
    is motion. Everything is compared with the last accepted keyframe, which moves with every acceptance.
    """

    def __init__(self, config: MotionConfig = MotionConfig()):
        self.c = config
        self.last_t: float | None = None
        self.grey: list[float] = []
        self.hist: list[float] = []
        self.hashes: list[int] = []
        self.over: list[bool] = []
        self.soft: list[tuple[float, float]] = []

    def _accept(self, t: float, grey, phash: int, hist, why: str) -> str:
        self.last_t, self.grey, self.hist, self.over, self.soft = t, [float(x) for x in grey], [float(x) for x in hist], [], []
        self.hashes = [*self.hashes, phash][-self.c.dedup_last :]
        return why

    def step(self, t: float, grey, phash: int, hist, motion: bool) -> str | None:
        c = self.c
        if self.last_t is None:
            return self._accept(t, grey, phash, hist, "first_frame")
        gap = t - self.last_t
        if gap < 1 / c.keyframe_hz or not (motion or gap > c.force_factor / c.keyframe_hz):
            return None
        score = float(np.abs(np.asarray(grey, float) - self.grey).mean())
        high = score > c.change_threshold
        # every check counts in both drift lanes
        self.soft = [(a, s) for a, s in (*self.soft, (t, score)) if t - a <= c.soft_window]
        self.over = [*self.over, high][-max(c.drift_window, c.drift_confirm) :]
        if not high:
            mean = _total(s for _, s in self.soft) / len(self.soft)
            drifts = c.drift_confirm > 0 and len(self.soft) >= c.soft_checks and mean > c.soft_ratio * c.change_threshold
            return self._accept(t, grey, phash, hist, "gradual_drift") if drifts else None
        fresh = (phash ^ self.hashes[-1]).bit_count() > c.phash_distance or _correlation(hist, self.hist) < c.hist_correlation
        if fresh:
            seen = any((phash ^ h).bit_count() < c.dedup_distance for h in self.hashes)
            return None if seen else self._accept(t, grey, phash, hist, "scene_change")
        if c.drift_confirm > 0 and sum(self.over) >= c.drift_confirm:
            return self._accept(t, grey, phash, hist, "gradual_drift")
        return None


def _total(values: Iterable[float]) -> float:
    """Added from left to right and rounded at each step, as SQL does; sum() and numpy keep or group what rounding loses, which decides ties."""
    return reduce(add, values, 0.0)


def _square(x: float) -> float:
    """By pow(), as SQL's ``**``; its last bit is not always that of x * x."""
    try:
        return math.pow(x, 2.0)
    except OverflowError:
        return math.inf


def _correlation(a, b) -> float:
    """Pearson correlation of two histograms; 1 where a side does not vary."""
    x, y = _centred(a), _centred(b)
    norm = math.sqrt(_total(map(_square, x)) * _total(map(_square, y)))
    return 1.0 if norm == 0 else _total(p * q for p, q in zip(x, y, strict=True)) / norm


def _centred(values) -> list[float]:
    x = [float(v) for v in values]
    mean = _total(x) / len(x) if x else 0.0
    return [v - mean for v in x]


def accept_keyframes(frames: DataFrame, config: MotionConfig = MotionConfig(), key: str = "long") -> DataFrame:
    """(video_id, seq, t, reason) of accepted keyframes, from (video_id, seq, t, grey, phash, hist, motion)."""
    fields = asdict(config)

    def start() -> Steps:
        state, mask = KeyframeState(MotionConfig(**fields)), (1 << 64) - 1

        def step(r) -> list[tuple]:
            why = state.step(r.t, r.grey, int(r.phash) & mask, r.hist, r.motion)
            return [(r.video_id, r.seq, r.t, why)] if why else []

        return Steps(step)

    return folded(frames, start, f"video_id {key}, seq long, t double, reason string")


def clean_segments(rows: DataFrame) -> DataFrame:
    """Cleaned text; what it was and ``cleaned`` where that changed it; empty and adjacent repeated texts go; noise is flagged."""
    from tempora.functions import exprs

    text = exprs.collapse_loops(F.coalesce(F.col("text"), F.lit("")))
    clean = rows.withColumn("raw_text", F.col("text")).withColumn("_stripped", exprs.strip(F.coalesce(F.col("text"), F.lit("")))).withColumn("text", text)
    changed = F.col("text") != F.col("_stripped")
    return (
        drop_adjacent(clean, "text").withColumn("raw_text", F.when(changed, F.col("raw_text"))).withColumn("cleaned", changed)
        .withColumn("hallucination", exprs.is_hallucination(F.col("text"))).drop("_stripped")
    )


def drop_adjacent(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose value differs from the one before; empty values go first and do not count."""
    filled = rows.where(F.col(column).isNotNull() & (F.col(column) != ""))
    return filled.withColumn("_p", F.lag(column).over(_order())).where(~F.col("_p").eqNullSafe(F.col(column))).drop("_p")


def trailing(rows: DataFrame, value: str, seconds: float) -> DataFrame:
    """Mean and number of values in the trailing window [t - seconds, t]."""
    return rows.withColumn("mean_v", _trailing(f"avg({value})", seconds)).withColumn("n", _trailing(f"count({value})", seconds))


def hard_drift(rows: DataFrame, over: Column, window: int = 5, confirm: int = 3) -> DataFrame:
    """Rows at which ``confirm`` of the last ``window`` checks were over (the form without resets)."""
    w = _order().rowsBetween(-(window - 1), 0)
    return rows.withColumn("n_over", F.sum(over.cast("int")).over(w)).where(F.col("n_over") >= confirm)


def keep_newest(rows: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` rows of each timeline, with how many were dropped from it; 0 keeps all."""
    newest = Window.partitionBy("video_id").orderBy(F.desc("t"), F.desc("seq"))
    counted = rows.withColumn("_k", F.row_number().over(newest)).withColumn("dropped", F.lit(0).cast("long"))
    if most:
        total = F.count("*").over(Window.partitionBy("video_id"))
        counted = counted.withColumn("dropped", F.greatest(total - most, F.lit(0)).cast("long")).where(F.col("_k") <= most)
    return counted.drop("_k")


def retained(files: DataFrame, quota: int) -> DataFrame:
    """Files (group, name, size) that stay when the oldest names go until the rest fits the quota."""
    newer = Window.partitionBy("group").orderBy(F.desc("name")).rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("held", F.sum("size").over(newer)).where(F.col("held") <= quota)


def budget_scores(signals: DataFrame, window: float = 30.0, retain: float = 1.5, type_weights: dict[str, float] | None = None, last: int = 200) -> DataFrame:
    """Weighted signals within the trailing window, of the last ``last`` signals at most, and whether they suffice to retain."""
    weights = F.coalesce(F.create_map(*[F.lit(x) for p in (type_weights or {"": 1.0}).items() for x in p])[F.col("type")], F.lit(1.0))
    held = F.collect_list(F.struct("t", (F.col("weight") * weights).alias("w"))).over(_order().rowsBetween(-(last - 1), 0))
    within = F.aggregate(F.filter("_h", lambda x: x["t"] >= F.col("t") - window), F.lit(0.0), lambda s, x: s + x["w"])
    return signals.withColumn("_h", held).withColumn("budget", within).drop("_h").withColumn("retain", F.col("budget") >= retain)


def carried_forward(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(_so_far()))


def guaranteed_anchors(rows: DataFrame, every: float = 30.0) -> DataFrame:
    """The first row, then each row at least ``every`` seconds after the last one taken."""

    names = rows.columns

    def start() -> Steps:
        last: list[float] = []

        def step(r) -> list[tuple]:
            if last and r.t - last[0] < every:
                return []
            last[:] = [r.t]
            return [tuple(getattr(r, n) for n in names)]

        return Steps(step)

    return folded(rows, start, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


def running_mean(values: Iterable[float], digits: int = 1) -> float | None:
    """Mean that is rounded at every step, as a live counter shows it."""
    mean = None
    for k, v in enumerate(values, 1):
        mean = round(v if mean is None else mean + (v - mean) / k, digits)
    return mean


def compact_timeline(rows: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` rows; older ones are one chapter from the first start to the last one's end, summaries that are not empty joined."""
    newest = Window.partitionBy("video_id").orderBy(F.desc("t"), F.desc("seq"))
    ranked = rows.withColumn("_k", F.row_number().over(newest))
    old = ranked.where(F.col("_k") > most).groupBy("video_id").agg(
        F.min("t").alias("t"), F.max_by("end_t", F.struct("t", "seq")).alias("end_t"),
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("t", "seq", "text"))), lambda s: s["text"]), lambda x: x != ""), "；").alias("text"),
        F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("chapter"),
    )
    return ranked.where(F.col("_k") <= most).select("video_id", "seq", "t", "end_t", "text", F.lit(False).alias("chapter")).unionByName(old.select("video_id", "seq", "t", "end_t", "text", "chapter"))


def text_delta(rows: DataFrame) -> DataFrame:
    """Hypotheses as increments: what is new after the last one, or all of it if that is no prefix."""
    before = F.coalesce(F.lag("text").over(_order()), F.lit(""))
    return rows.withColumn("delta", F.when(F.startswith("text", before), F.substr("text", F.length(before) + 1)).otherwise(F.col("text")))
