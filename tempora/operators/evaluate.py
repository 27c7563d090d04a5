"""Evaluation: gaps, coverage, redundancy, Gini, change profiles; evidence packs and the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators import intervals


def gap_summary(rows: DataFrame) -> DataFrame:
    """Count, span, mean, 95th percentile (interpolated) and largest gap between neighbours of each timeline."""
    gap = F.lead("t").over(Window.partitionBy("video_id").orderBy("t", "seq")) - F.col("t")
    return rows.withColumn("gap", gap).groupBy("video_id").agg(
        F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"), F.avg("gap").alias("mean_gap"),
        F.percentile("gap", F.lit(0.95)).alias("p95_gap"), F.max("gap").alias("max_gap"),
    )


def coverage(scenes: DataFrame, assigned: DataFrame) -> DataFrame:
    """Duration-weighted coverage, covered scenes, and representatives for each scene, of each timeline."""
    per = assigned.where("scene is not null").groupBy("video_id", "scene").agg(F.count("*").alias("reps"))
    all_ = scenes.join(per, ["video_id", "scene"], "left").withColumn("reps", F.coalesce("reps", F.lit(0)))
    length = F.col("end_t") - F.col("start_t")
    return all_.groupBy("video_id").agg(
        F.count("*").alias("scenes"), F.count_if(F.col("reps") > 0).alias("covered"), F.sum("reps").alias("reps"),
        (F.sum(F.when(F.col("reps") > 0, length).otherwise(0.0)) / F.nullif(F.sum(length), F.lit(0.0))).alias("coverage"),
        (F.sum("reps") / F.count("*")).alias("redundancy"),
    )


def gini(rows: DataFrame, value: str) -> DataFrame:
    """(2 sum i x_i - (n + 1) sum x) / (n sum x), x ascending; 0 where there is nothing."""
    i = F.row_number().over(Window.partitionBy("video_id").orderBy(value))
    n, s = F.count("*"), F.sum(value)
    return rows.withColumn("_i", i).groupBy("video_id").agg(
        F.coalesce((2 * F.sum(F.col("_i") * F.col(value)) - (n + 1) * s) / F.nullif(n * s, F.lit(0.0)), F.lit(0.0)).alias("gini")
    )


def change_profile(rows: DataFrame, value: str, width: float = 1.0) -> DataFrame:
    """Absolute change between the first and last row of each tumbling window."""
    w = F.floor(F.col("t") / F.lit(float(width)))
    order = F.struct("t", "seq")
    return rows.groupBy("video_id", w.cast("long").alias("w")).agg(F.abs(F.max_by(value, order) - F.min_by(value, order)).alias("change"))


def changed_coverage(changed: DataFrame, kept: DataFrame, within: float) -> DataFrame:
    """Share of changed times with a kept time within ``within`` seconds; 1 where nothing changed."""
    near = kept.select("video_id", (F.col("t") - within).alias("lo"), (F.col("t") + within).alias("hi"))
    hit = intervals.interval_join(near, changed, lo="lo", hi="hi", at="t", width=4 * within, how="left_semi").groupBy("video_id").agg(F.count("*").alias("hit"))
    every = changed.groupBy("video_id").agg(F.count("*").alias("n"))
    videos = kept.select("video_id").union(changed.select("video_id")).distinct()
    return videos.join(every, "video_id", "left").join(hit, "video_id", "left").select(
        "video_id", F.coalesce(F.coalesce("hit", F.lit(0)) / F.col("n"), F.lit(1.0)).alias("coverage")
    )


def far_from_all(points: DataFrame, borders: DataFrame, within: float) -> DataFrame:
    """Points farther than ``within`` from every border."""
    near = borders.select("video_id", (F.col("t") - within).alias("lo"), (F.col("t") + within).alias("hi"))
    return intervals.interval_join(near, points, lo="lo", hi="hi", at="t", width=4 * within, how="left_anti")


def type_counts(events: DataFrame, kinds: list[str]) -> DataFrame:
    return events.groupBy("video_id").agg(*[F.count_if(F.col("type") == k).alias(k) for k in kinds], F.count("*").alias("total"))


def evidence_packs(segments: DataFrame, keyframes: DataFrame, windows: DataFrame, *, most: int = 3, reach: float = 30.0, width: float = 600.0) -> DataFrame:
    """A pack for each segment (video_id, seq, start_t, end_t, text, motion, linked) of positive length with any evidence.

    ``motion`` and ``linked`` are the aligned windows' counts of motion events and keyframes, whose end is open.
    Frames are the first three within [start, end]; without any, the nearest to either end if one of them
    lies within ``reach``. Reasons come in fixed order; ids are dense after segments without reasons are left out.
    """
    seg = segments.where("end_t > start_t")
    inside = intervals.interval_join(seg.select("video_id", "seq", "start_t", "end_t"), keyframes.select("video_id", "t"), lo="start_t", hi="end_t", at="t", width=width)
    held = inside.groupBy("video_id", "seq").agg(F.array_sort(F.collect_list("t")).alias("f"))
    near = _nearest_both(seg, keyframes)
    hot = intervals.overlap_semi(seg.select("video_id", "seq", "start_t", "end_t"), windows, width).select("video_id", "seq", F.lit(True).alias("attention"))
    all_ = seg.join(held, ["video_id", "seq"], "left").join(near, ["video_id", "seq"], "left").join(hot, ["video_id", "seq"], "left")
    gap = F.least(F.abs(F.col("near_start") - F.col("start_t")), F.abs(F.col("near_end") - F.col("end_t")))
    fallback = F.when(gap <= reach, F.slice(F.array_distinct(F.array_sort(F.array("near_start", "near_end"))), 1, most))
    frames = F.coalesce(F.slice("f", 1, most), fallback, F.array().cast("array<double>"))
    speech = F.when(F.length(F.coalesce("text", F.lit(""))) > 0, F.lit("speech"))
    reasons = F.array_compact(F.array(
        speech, F.when(F.col("motion") > 0, F.lit("motion")), F.when(F.col("linked") > 0, F.lit("keyframe")), F.when(F.col("attention"), F.lit("attention"))
    ))
    packs = all_.withColumn("frames", frames).withColumn("reasons", reasons).where(F.size("reasons") > 0)
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("start_t", "seq")) - 1
    return packs.select(
        "video_id", F.format_string("ev_%04d", rank).alias("event_id"), "start_t", "end_t", "frames", F.left(F.coalesce("text", F.lit("")), F.lit(500)).alias("speech"),
        F.coalesce("linked", F.lit(0)).cast("long").alias("keyframes_in_range"), "reasons", F.least(F.lit(1.0), F.size("reasons") / 4.0).alias("confidence"),
    )


def _nearest_both(seg: DataFrame, keyframes: DataFrame) -> DataFrame:
    """The keyframe nearest to each segment's start and end, by filling forward and backward in one sorted pass each."""
    out = None
    for name, at in (("near_start", "start_t"), ("near_end", "end_t")):
        marks = seg.select("video_id", F.col(at).alias("t"), "seq", F.lit(None).cast("double").alias("k")).unionByName(
            keyframes.select("video_id", "t", F.lit(None).cast("long").alias("seq"), F.col("t").alias("k"))
        )
        w = Window.partitionBy("video_id").orderBy("t")
        before = F.last("k", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
        after = F.first("k", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
        pick = F.when(after.isNull() | (F.col("t") - before <= after - F.col("t")), before).otherwise(after)
        found = marks.withColumn(name, pick).where("seq is not null").select("video_id", "seq", name)
        out = found if out is None else out.join(found, ["video_id", "seq"])
    return out


def candidate_ranges(asr: DataFrame, ocr: DataFrame, attention: DataFrame, matches: Column, gap: float = 10.0) -> DataFrame:
    """Time ranges worth a closer look: transcript and text hits padded, every attention window, merged."""
    a = asr.where(matches).select("video_id", F.col("t").alias("a"), F.coalesce("end_t", F.col("t") + 2.0).alias("b"), "seq")
    o = ocr.where(matches).select("video_id", (F.col("t") - 2.0).alias("a"), (F.col("t") + 5.0).alias("b"), "seq")
    w = attention.select("video_id", F.col("t").alias("a"), F.coalesce("end", F.col("t") + 5.0).alias("b"), "seq")
    return intervals.merge_ranges(a.unionByName(o).unionByName(w), gap)


def grid_tokens(images: DataFrame, columns: int = 3) -> DataFrame:
    """Contact sheets of columns² images: cells as large as the largest, and tokens one by one against in sheets."""
    from tempora.functions.exprs import image_tokens

    per = columns * columns
    k = F.row_number().over(Window.partitionBy("video_id").orderBy("t", "seq")) - 1
    sheets = images.withColumn("sheet", F.floor(k / per)).groupBy("video_id", "sheet").agg(
        F.count("*").alias("n"), F.max("w").alias("cw"), F.max("h").alias("ch"), F.sum(image_tokens(F.col("w"), F.col("h"))).alias("direct")
    )
    across, down = F.least(F.col("n"), F.lit(columns)), F.ceil(F.col("n") / columns)
    return sheets.groupBy("video_id").agg(
        F.sum("direct").alias("direct_tokens"), F.sum(image_tokens(F.col("cw") * across, F.col("ch") * down)).alias("grid_tokens"), F.count("*").alias("sheets")
    )


def top_changes(profile: DataFrame, k: int = 3) -> DataFrame:
    """The k windows of each timeline that changed most; ties to the earliest."""
    w = Window.partitionBy("video_id").orderBy(F.desc("change"), "w")
    return profile.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def verdicts(measured: DataFrame, specs: DataFrame) -> DataFrame:
    """(name, passed) for each spec (name, least, most) and one row ``all``; what was not measured fails."""
    ok = F.coalesce((F.col("value") >= F.coalesce("least", F.col("value"))) & (F.col("value") <= F.coalesce("most", F.col("value"))), F.lit(False))
    each = specs.join(measured, "name", "left").select("name", ok.alias("passed"))
    return each.unionByName(each.agg(F.lit("all").alias("name"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed")))


def pipeline_summary(events: DataFrame, timings: DataFrame, last: int = 200) -> DataFrame:
    """Counts by kind, and mean time and rate of the last frames of each timeline."""
    newest = Window.partitionBy("video_id").orderBy(F.desc("seq"))
    speed = timings.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= last).groupBy("video_id").agg(F.avg("seconds").alias("mean_seconds"))
    counts = events.groupBy("video_id").agg(
        F.count_if(F.col("type").startswith("motion")).alias("motion_events"), F.count_if(F.col("type") == "keyframe").alias("keyframes"), F.count("*").alias("events")
    )
    return counts.join(speed, "video_id", "left").withColumn("fps", F.lit(1.0) / F.nullif("mean_seconds", F.lit(0.0)))


def speech_totals(segments: DataFrame, runs: DataFrame) -> DataFrame:
    """Of each run (run, audio_s, decode_s) the segments and signs that it gave (run, text), and decoding time against audio time."""
    n = segments.groupBy("run").agg(F.count("*").alias("segments"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("segments", "chars")]
    return runs.join(n, "run", "left").select("run", "audio_s", "decode_s", *zero, (F.col("decode_s") / F.nullif("audio_s", F.lit(0.0))).alias("rtf"))


def lookup(rows: DataFrame, runs: DataFrame, by: str, order: str) -> DataFrame:
    """``rows`` with the first of ``runs`` of their name in the order of ``order``; null where there is none."""
    rest = [c for c in runs.columns if c != by]
    first = runs.groupBy(by).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_run"))
    return rows.join(first, by, "left").select(*rows.columns, *[F.col(f"_run.{c}").alias(c) for c in rest])
