"""Interval algebra on timelines: tilings, unions, overlaps, bands and nearest matches.

Range predicates alone would be nested loops. Tilings are filled forward in one sorted pass; other range
joins are equi-joins on time bins with the range as residual, so that one long timeline spreads over bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.fold import Steps, folded


def tiles(segments: DataFrame, tail: float) -> DataFrame:
    """Segments with their windows [t0, t1): up to the next segment, the last one to end_t or t + tail."""
    w = Window.partitionBy("video_id").orderBy("t", "seq")
    last = F.coalesce(F.col("end_t"), F.col("t") + tail) if "end_t" in segments.columns else F.col("t") + tail
    return segments.withColumn("t0", F.col("t")).withColumn("t1", F.coalesce(F.lead("t").over(w), last))


def align(segments: DataFrame, events: DataFrame, tail: float) -> DataFrame:
    """Left outer: every segment with its counts of motion and keyframe events and its motion types.

    A window holds its start and not its end. Of segments that start together only the last has a window.
    """
    seg = tiles(segments, tail).select("video_id", "t", F.lit(0).alias("rank"), "seq", F.struct("seq", "t0", "t1").alias("s"), F.lit(None).cast("string").alias("type"))
    ev = events.select("video_id", "t", F.lit(1).alias("rank"), "seq", F.lit(None).cast(seg.schema["s"].dataType).alias("s"), "type")
    fill = Window.partitionBy("video_id").orderBy("t", "rank", "seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = seg.unionByName(ev).withColumn("own", F.last("s", ignorenulls=True).over(fill)).where("own is not null")
    held = (F.col("rank") == 1) & (F.col("t") < F.col("own.t1"))
    motion = held & F.col("type").startswith("motion")
    return (
        placed.groupBy("video_id", F.col("own.seq").alias("seq"), F.col("own.t0").alias("t0"), F.col("own.t1").alias("t1"))
        .agg(
            F.count_if(motion).alias("linked_motion_events"),
            F.count_if(held & (F.col("type") == "keyframe")).alias("linked_keyframes"),
            F.array_join(F.array_sort(F.collect_set(F.when(motion, F.col("type")))), ",").alias("motion_types"),
        )
    )


def merge_ranges(ranges: DataFrame, gap: float, *, keep: str | None = None) -> DataFrame:
    """Union of ranges (video_id, seq, a, b): a range joins the one before if it starts at most ``gap`` after its end.

    With ``keep`` each union has that column of its first range.
    """
    w = Window.partitionBy("video_id").orderBy("a", "b", "seq")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("a") > reach + gap), 1).otherwise(0)
    islands = ranges.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = [F.min("a").alias("start_t"), F.max("b").alias("end_t"), F.count("*").alias("n")]
    if keep:
        cells.append(F.min_by(keep, F.struct("a", "b", "seq")).alias(keep))
    return islands.groupBy("video_id", "_g").agg(*cells).drop("_g")


def bins(t: Column, width: float) -> Column:
    return F.floor(t / F.lit(float(width))).cast("long")


def interval_join(left: DataFrame, right: DataFrame, *, lo: str, hi: str, at: str, width: float, how: str = "inner") -> DataFrame:
    """Rows of ``left`` with interval [lo, hi] and rows of ``right`` whose ``at`` lies in it, both ends in.

    The interval is spread over bins of ``width``; ``right`` lies in one bin, so each pair meets once. ``how``
    is inner, or left_semi/left_anti to keep the rows of ``right`` (they are the preserved side then).
    """
    l = left.withColumn("_bin", F.explode(F.sequence(bins(F.col(lo), width), bins(F.col(hi), width))))  # noqa: E741
    r = right.withColumn("_bin", bins(F.col(at), width))
    if how == "inner":
        return l.join(r, ["video_id", "_bin"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("_bin")
    l = l.select(F.col("video_id").alias("_v"), F.col("_bin").alias("_b"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))  # noqa: E741
    on = (F.col("video_id") == F.col("_v")) & (F.col("_bin") == F.col("_b")) & F.col(at).between(F.col("_lo"), F.col("_hi"))
    return r.join(l, on, how).drop("_bin")


def overlap_semi(left: DataFrame, right: DataFrame, width: float) -> DataFrame:
    """Rows of ``left`` (start_t, end_t) that overlap any of ``right`` (t, end), ends included."""
    spread = F.explode(F.sequence(bins(F.col("start_t"), width), bins(F.col("end_t"), width)))
    l = left.select("video_id", "start_t", "end_t").distinct().withColumn("_bin", spread)  # noqa: E741
    r = right.select(F.col("video_id").alias("_v"), F.col("t").alias("_t"), F.col("end").alias("_e")).withColumn(
        "_b", F.explode(F.sequence(bins(F.col("_t"), width), bins(F.col("_e"), width)))
    )
    on = (F.col("video_id") == F.col("_v")) & (F.col("_bin") == F.col("_b")) & (F.col("start_t") <= F.col("_e")) & (F.col("_t") <= F.col("end_t"))
    met = l.join(r, on, "left_semi").select("video_id", "start_t", "end_t").distinct()
    return left.join(met, ["video_id", "start_t", "end_t"], "left_semi").select(left.columns)


def band_best(left: DataFrame, right: DataFrame, *, band: float, score: Column, least: float) -> DataFrame:
    """For each row of ``left`` the row of ``right`` within ``band`` seconds with the highest score.

    Ties go to the first in the order of ``right``; rows with less than ``least`` have none (inner result).
    ``right`` has columns r_t and r_seq; the result has the score as ``sim``.
    """
    l = left.withColumn("_bin", F.explode(F.sequence(bins(F.col("t") - band, band), bins(F.col("t") + band, band))))  # noqa: E741
    met = l.join(right.withColumn("_bin", bins(F.col("r_t"), band)), ["video_id", "_bin"]).where(F.abs(F.col("r_t") - F.col("t")) <= band)
    best = Window.partitionBy("video_id", "seq").orderBy(F.desc("sim"), "r_seq")
    return met.withColumn("sim", score).withColumn("_k", F.row_number().over(best)).where((F.col("_k") == 1) & (F.col("sim") >= least)).drop("_k", "_bin")


def nearest_in_padded(windows: DataFrame, frames: DataFrame, pad: float, width: float) -> DataFrame:
    """For each window (t, end) the frame within [t - pad, end + pad] nearest to t; ties to the earliest."""
    w = windows.select("video_id", F.col("seq").alias("w_seq"), F.col("t").alias("w_t"), (F.col("t") - pad).alias("lo"), (F.col("end") + pad).alias("hi"))
    met = interval_join(w, frames.select("video_id", "t"), lo="lo", hi="hi", at="t", width=width)
    return met.groupBy("video_id", "w_seq").agg(F.min_by("t", F.struct(F.abs(F.col("t") - F.col("w_t")), "t")).alias("t"))


def force_include(selected: DataFrame, windows: DataFrame, frames: DataFrame, pad: float = 5.0, same: float = 0.05, width: float = 60.0) -> DataFrame:
    """``selected`` times with each window's nearest frame added, to a tenth of a second, unless one lies within ``same`` seconds.

    Windows come in order of (t, seq), and what an earlier one added counts for later ones.
    """
    offered = nearest_in_padded(windows, frames, pad, width).join(windows.select("video_id", F.col("seq").alias("w_seq"), F.col("t").alias("w_t")), ["video_id", "w_seq"])
    near = selected.select(F.col("video_id").alias("_v"), F.col("t").alias("_t"), F.explode(F.sequence(bins(F.col("t") - same, same), bins(F.col("t") + same, same))).alias("_b"))
    on = (F.col("video_id") == F.col("_v")) & (bins(F.col("at"), same) == F.col("_b")) & (F.abs(F.col("at") - F.col("_t")) < same)
    fresh = offered.select("video_id", F.col("w_seq").alias("seq"), F.col("w_t").alias("t"), F.col("t").alias("at")).join(near, on, "left_anti")

    def start() -> Steps:
        kept: dict[int, list[float]] = {}

        def step(r) -> list[tuple]:
            b = int(r.at // same)
            if any(abs(x - r.at) < same for k in (b - 1, b, b + 1) for x in kept.get(k, ())):
                return []
            t = round(r.at, 1)
            kept.setdefault(int(t // same), []).append(t)
            return [(r.video_id, t)]

        return Steps(step)

    return selected.select("video_id", "t").union(folded(fresh, start, "video_id long, t double"))


def first_match(points: DataFrame, scenes: DataFrame, eps: float = 1e-6, width: float = 600.0) -> DataFrame:
    """Points with the index of the first scene that holds them within eps, null if none does."""
    s = scenes.select("video_id", "scene", (F.col("start_t") - eps).alias("lo"), (F.col("end_t") + eps).alias("hi"))
    hit = interval_join(s, points, lo="lo", hi="hi", at="t", width=width).where(F.col("t") < F.col("hi"))
    found = hit.groupBy("video_id", "seq").agg(F.min("scene").alias("scene"))
    return points.join(found, ["video_id", "seq"], "left")


def texts_around(points: DataFrame, subtitles: DataFrame, pad: float, width: float = 60.0) -> DataFrame:
    """(video_id, seq, texts): of each point the subtitles (s_t, s_end, s_text) that overlap it within ``pad`` seconds, in order."""
    p = points.withColumn("_bin", F.explode(F.sequence(bins(F.col("t") - pad, width), bins(F.col("t") + pad, width))))
    s = subtitles.withColumn("_bin", F.explode(F.sequence(bins(F.col("s_t"), width), bins(F.col("s_end"), width))))
    met = p.join(s, ["video_id", "_bin"]).where((F.col("s_t") <= F.col("t") + pad) & (F.col("s_end") >= F.col("t") - pad))
    one = met.select("video_id", "seq", "s_t", "s_seq", "s_text").distinct()
    held = one.groupBy("video_id", "seq").agg(F.array_sort(F.collect_list(F.struct("s_t", "s_seq", "s_text"))).alias("h"))
    texts = F.transform("h", lambda x: x["s_text"])
    return points.select("video_id", "seq").join(held, ["video_id", "seq"], "left").select("video_id", "seq", F.coalesce(texts, F.array().cast("array<string>")).alias("texts"))


def scene_of(points: DataFrame, scenes: DataFrame, width: float = 600.0) -> DataFrame:
    """Points with the scene whose half-open interval holds them; points outside all scenes go."""
    s = scenes.select("video_id", "scene", F.col("start_t").alias("lo"), F.col("end_t").alias("hi"))
    return interval_join(s, points, lo="lo", hi="hi", at="t", width=width).where(F.col("t") < F.col("hi")).groupBy("video_id", "seq").agg(F.min("scene").alias("scene"))
