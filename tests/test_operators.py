"""Operators on hand-made timelines: boundaries, ties, resets, and the batch against the stream."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tempora.functions import exprs, plugins, vision
from tempora.operators import evaluate, intervals, select, sequences
from tempora.schema import MotionConfig
from tempora.sources import readers
from tempora.streaming import live


def one(spark, c, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(c.alias("x")).first()["x"]


def test_text(spark):
    c = F.col("s")
    assert one(spark, exprs.collapse_loops(c), s="  hahahaha ok ") == "ha ok"
    assert one(spark, exprs.collapse_loops(c), s="aaaaaa") == "aa"
    assert one(spark, exprs.is_hallucination(c), s="THANK YOU") and not one(spark, exprs.is_hallucination(c), s="this is a plain sentence here")
    assert one(spark, exprs.first_cue(c, ["b", "a"]), s="xAb") == "b" and one(spark, exprs.first_cue(c, ["q"]), s="x") is None
    assert one(spark, exprs.bigrams(c), s="a b c") == ["ab", "bc"] and one(spark, exprs.bigrams(c), s="a") == ["a"] and one(spark, exprs.bigrams(c), s=" ") == []
    assert one(spark, exprs.first_object(c), s='x {"a": {"b": 1}} y') == '{"a": {"b": 1}}' and one(spark, exprs.first_object(c), s="{no") is None
    assert one(spark, exprs.file_time(c), s="d/kf_0003_t12.5s.jpg") == 12.5
    assert [one(spark, exprs.url_allowed(c), s=u) for u in ("https://a.b/c", "http://localhost:1/x", "http://a.b", "ftp://a", "x")] == [True, True, False, False, False]
    assert not one(spark, exprs.path_safe(c), s="a\\..\\b") and one(spark, exprs.path_safe(c), s="a/..b")


def test_vectors(spark):
    a, b = F.array(*[F.lit(x) for x in (1.0, 0.0)]), F.array(*[F.lit(x) for x in (0.0, 2.0)])
    assert one(spark, exprs.cosine_distance(a, b), s=1) == 1.0
    assert one(spark, exprs.cosine_distance(a, F.array(F.lit(0.0), F.lit(0.0))), s=1) == 0.0
    assert one(spark, exprs.image_tokens(F.lit(1920), F.lit(1080)), s=1) == 2765
    assert tuple(one(spark, exprs.fitted_size(F.lit(1920), F.lit(1080)), s=1)) == (640, 360)


def test_motion_segments(spark):
    kinds = "0 g g s g g g g s g 0 g g g 0".split()  # two gated, a small one, then a confirmed run
    rows = [(1, k, k * 0.25, 0 if x == "0" else 1, x == "g", 0.1 * k) for k, x in enumerate(kinds)]
    df = spark.createDataFrame(rows, "video_id long, seq long, t double, boxes int, gated boolean, ratio double")
    got = sequences.motion_segments(df, MotionConfig()).orderBy("start_t").collect()
    assert [(r["start_t"], r["end_t"], r["closed_t"], r["kept"]) for r in got] == [(1.5, 2.25, 2.5, True), (3.25, 3.25, 3.5, False)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 80), st.integers(0, 15)), min_size=1, max_size=25), st.integers(0, 10))
def test_union_rule(ranges, gap):
    """What merge_ranges states, in plain Python, covers every range and keeps unions apart."""
    out = []
    for a, b in sorted((a, a + n) for a, n in ranges):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    assert all(any(x <= a and a + n <= y for x, y in out) for a, n in ranges)
    assert all(q[0] > p[1] + gap for p, q in zip(out, out[1:], strict=False))


def test_merge_boundary(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0, 0), (1, 30.0, 31.0, 1), (1, 41.1, 42.0, 2)], "video_id long, a double, b double, seq long")
    got = sorted(tuple(r) for r in intervals.merge_ranges(df, 10.0).select("start_t", "end_t", "n").collect())
    assert got == [(10.0, 31.0, 2), (41.1, 42.0, 1)]


def test_first_match_boundary(spark):
    scenes = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 10.0, 15.0)], "video_id long, scene long, start_t double, end_t double")
    points = spark.createDataFrame([(1, 0, 10.0), (1, 1, 12.0), (1, 2, -1.0), (1, 3, 35.0)], "video_id long, seq long, t double")
    assert {r["seq"]: r["scene"] for r in intervals.first_match(points, scenes).collect()} == {0: 0, 1: 1, 2: None, 3: None}


def test_greedy():
    assert select.greedy_starts(np.array([1, 29, 31, 60, 62.0]), 30).tolist() == [0, 0, 31, 31, 62]
    assert select.greedy_starts(np.array([45.0, 50]), 30).tolist() == [45, 45]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0, 1000), min_size=1, max_size=40), st.floats(1, 100))
def test_greedy_cover(times, width):
    t = np.sort(np.array(times))
    s = select.greedy_starts(t, width)
    assert (t - s < width).all() and (np.diff(s) >= 0).all()


def test_farthest():
    v = np.array([[1, 0], [1, 0.1], [0, 1], [-1, 0.0]])
    chosen, scores = select.farthest(v, 3)
    assert chosen[:2] == [3, 0] and chosen[2] == 2
    assert select.farthest(v[:1], 5)[0] == [0] and scores[0] == pytest.approx(2.0)


def test_budget():
    assert select.budget_interval(lambda w: int(1000 / w), 1000, 10) == 100
    assert sequences.running_mean([1.0, 2.0, 4.0]) == pytest.approx(2.3)


def test_keyframe_lanes():
    k = sequences.KeyframeState(MotionConfig())
    flat, other = [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]
    far = (1 << 40) - 1
    step = lambda t, grey, h=0, hist=flat, motion=True: k.step(t, [grey], h, hist, motion)
    assert step(0, 0.0) == "first_frame" and step(0.5, 90.0) is None  # too soon
    assert step(1, 20.0, far, other) == "scene_change" and k.grey == [20.0]  # the reference moves
    assert step(2, 20.0, far, other) is None
    assert step(3, 40.0, 0) is None  # a new scene like a recent one gives nothing, not even drift
    assert [step(t, 35.0, far, other) for t in (4, 5)] == [None, "gradual_drift"]
    assert step(6, 200.0, far, other, motion=False) is None and step(9.5, 200.0, ~far & (2**64 - 1), flat, motion=False) == "scene_change"


def test_drift_lanes():
    k = sequences.KeyframeState(MotionConfig())
    at = lambda t, grey: k.step(t, [grey], 0, [1.0, 2.0], True)
    at(0, 0)
    assert [at(t, 20) for t in (1, 2, 3)] == [None, None, "gradual_drift"]
    assert [at(t, 28) for t in (4, 5)] == [None, "gradual_drift"]
    # a high check counts in the soft lane: 20 then 1 has a mean above six tenths of ten
    assert [at(6, 48), at(7, 29)] == [None, "gradual_drift"]
    quiet = sequences.KeyframeState(MotionConfig(drift_confirm=0))
    quiet.step(0, [0.0], 0, [1.0, 2.0], True)
    assert [quiet.step(t, [8.0], 0, [1.0, 2.0], True) for t in range(1, 9)] == [None] * 8


def test_force_include_chain(spark):
    frames = spark.createDataFrame([(1, 10.0), (1, 10.04), (1, 10.08), (1, 30.0)], "video_id long, t double")
    windows = spark.createDataFrame([(1, 0, 10.0, 10.0), (1, 1, 10.04, 10.04), (1, 2, 10.08, 10.08), (1, 3, 30.01, 30.01)], "video_id long, seq long, t double, end double")
    chosen = spark.createDataFrame([(1, 30.03)], "video_id long, t double")
    got = sorted(r["t"] for r in intervals.force_include(chosen, windows, frames, pad=0.02).collect())
    assert got == [10.0, 10.1, 30.03]


def test_aligner_waits_for_late_speech():
    state: dict = {}
    seen = [("asr", 0.0), ("keyframe", 6.0), ("motion", 3.0), ("asr", 5.0), ("keyframe", 7.0), ("asr", 9.0), ("end", 12.0)]
    out = [x for k, (kind, t) in enumerate(seen) for x in live.align_step(state, {"type": kind, "t": t, "seq": k})]
    assert [(x["t0"], x["t1"], x["linked_motion_events"], x["linked_keyframes"]) for x in out] == [(0.0, 5.0, 1, 0), (5.0, 9.0, 0, 2), (9.0, 11.0, 0, 0)]
    assert live.flush_align(state, 2.0) == []


def test_cleaner_parity(spark):
    texts = ["  hahahaha ", "ha", "", None, "x", " x", "OKOKOKOK YES", "no no no no", "a\tb"]
    df = spark.createDataFrame([(1, k, float(k), t) for k, t in enumerate(texts)], "video_id long, seq long, t double, text string")
    batch = [(r["seq"], r["text"], r["raw_text"]) for r in sequences.clean_segments(df).orderBy("seq").collect()]
    state: dict = {}
    stream = [(x["seq"], x["text"], x["raw_text"]) for k, t in enumerate(texts) for x in live.clean_step(state, {"seq": k, "t": k, "text": t})]
    assert batch == stream and batch[0] == (0, "ha", "  hahahaha ") and [r[0] for r in batch] == [0, 4, 6, 7, 8]


def test_collapse_is_the_pattern(spark):
    """Whole texts against the pattern in plain Python."""
    import re

    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab \n"), int(rng.integers(0, 200)))) for _ in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, s string")
    got = {r["k"]: r["x"] for r in df.select("k", exprs.collapse_loops(F.col("s")).alias("x")).collect()}
    assert all(got[k] == re.sub(r"(.{1,4})\1{2,}", r"\1", t.strip()) for k, t in enumerate(texts))


def test_sources_say_what_is_missing(spark):
    spark.dataSource.register(readers.FrameSource)
    with pytest.raises(Exception, match="no cam backend"):
        spark.read.format("frames").option("kind", "cam").load().count()


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 4.0), (2, 0.0)], "video_id long, x double")
    assert {r["video_id"]: round(r["gini"], 4) for r in evaluate.gini(df, "x").collect()} == {1: 0.3333, 2: 0.0}


def test_stream_matches_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    kinds = ["asr", "motion", "keyframe", "motion_end"]
    rows = [(int(k % 3), k, float(k), kinds[int(rng.integers(4))], "a" if rng.random() < 0.5 else "b") for k in range(120)]
    schema = "video_id long, seq long, t double, type string, text string"
    for i in range(3):
        some = rows[40 * i : 40 * i + 40] + [(v, 999, 999.0, "end", None) for v in range(3)] * (i == 2)
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, twin in (("align", live.align), ("clean", live.clean)):
        q = twin(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    df = spark.createDataFrame(rows, schema)
    batch = {(r["video_id"], r["seq"]): r for r in intervals.align(df.where("type = 'asr'"), df, 2.0).collect()}
    stream = spark.table("align").collect()
    assert stream and all(batch[r["video_id"], r["seq"]].asDict() == r.asDict() for r in stream) and len(batch) == len(stream)
    assert spark.table("clean").count() == sequences.clean_segments(df.where("type <> 'end'")).count()


def test_trigger():
    t = live.Trigger()
    assert t.step({"type": "keyframe", "t": 0.0, "reason": "first_frame"}) is None
    w = t.step({"type": "asr", "t": 1.0, "text": "x"})
    assert w["asr"] == "x" and w["t0"] == 0.0 and t.step({"type": "asr", "t": 5.0, "text": "y"}) is None
    assert t.step({"type": "keyframe", "t": 9.0, "reason": "scene_change"})["asr"] == "y"
    assert t.failed({**live.empty_window(), "asr": "z", "t0": 1.0, "retries": 2})
    assert t.due and t.window["asr"] == "z" and t.window["retries"] == 3
    assert not t.failed(t.window) and t.dropped == 1


def test_trigger_defers():
    shot = lambda t, **more: {"type": "keyframe", "t": t, "reason": "scene_change", **more}
    t = live.Trigger(floor=0)
    assert [t.step(shot(x, ego_suspect=True)) is not None for x in (0.0, 29.0, 30.0, 31.0)] == [False, False, True, False]
    assert t.step(shot(40.0)) is not None
    never = live.Trigger(floor=0, defer=0)
    assert all(never.step(shot(x, ego_suspect=True)) is None for x in (0.0, 1e6)) and len(never.window["kf"]) == 2
    assert never.step({"type": "asr", "t": 1e6, "text": "a", "ego_suspect": True})
    alone = live.Trigger(floor=0)
    assert alone.step({"type": "motion_end", "t": 1.0, "duration": 9.0}) is None and not alone.due


def test_understanding_retries():
    import json

    model = plugins.ScriptedModel(['{"now": "ok"}'], fail_next=1)
    state, rows = {}, []
    for t in (0.0, 1.0, 2.5, 5.0, 11.0):
        rows += live.understanding_step(state, {"seq": int(t), "type": "asr", "t": t, "text": str(t)}, lambda speech, kf: model(speech), {})
        state = json.loads(json.dumps(state))
    assert [(r["t"], r["retries"], r["now"]) for r in rows] == [(0.0, 0, None), (2.5, 1, "ok"), (11.0, 0, "ok")]
    assert live.understanding_step({}, {"seq": 0, "type": "asr", "t": 0.0, "text": "x"}, None, {}) == []
    assert [live.answer(x) for x in ('a {"now": "b"} c', "plain", None, "{no}")] == ["b", "plain", "", "{no}"]


def test_reconnects():
    from tempora.sources.reconnect import Mailbox, Reconnecting, Stats

    def connect():
        yield from (1, 2)
        raise OSError("gone")

    source = Reconnecting(connect, budget=2, delay=0)
    assert list(source) == [1, 2] * 3
    assert source.stats.reconnects == 2 and source.stats.down and "gone" in source.stats.error
    box = Mailbox(Stats())
    box.put(1), box.put(2)
    assert box.take(0) == 2 and box.take(0) is None and (box.stats.read, box.stats.dropped) == (1, 1)


def test_plugin_tables(spark):
    rows = spark.createDataFrame([(1, 1, 0.12345, bytearray(b"a\n \nbc"))], "video_id long, seq long, t double, content binary")
    assert [tuple(r) for r in plugins.read_text(rows, "mock").collect()] == [(1, 1, 0, 0.123, "a", 0.01), (1, 1, 2, 0.123, "bc", 0.02)]
    assert plugins.embed(rows, "mock").first()["v"][0] == 6.0
    sound = spark.createDataFrame([(1, bytearray(np.zeros(16_000 * 15 + 3_199, np.float32).tobytes()))], "video_id long, samples binary")
    assert [tuple(r) for r in plugins.transcribe(sound, "mock").collect()] == [(1, 0.0, "240000 samples")]


def test_asking_an_index(spark, tmp_path):
    import json

    from tempora.operators import focus

    doc = {"asr": [{"t": 5.0, "end_t": 8.0, "text": "Key point"}, {"t": 100.0, "end_t": 101.0, "text": "other"}], "attention_windows": [{"t": 40.0, "end": 50.0}]}
    (tmp_path / "index.json").write_text(json.dumps(doc))
    frames = spark.createDataFrame([(0, k, k / 2, [float(k // 20 * 90)] * 4, 0, [1.0, 2.0], True) for k in range(110)], "video_id long, seq long, t double, grey array<double>, phash long, hist array<double>, motion boolean")
    got = focus.query_index(spark, str(tmp_path / "index.json"), frames, ["key"])
    assert [(r.start_t, r.end_t) for r in got["ranges"].orderBy("start_t").collect()] == [(5.0, 8.0), (40.0, 50.0)]
    first = got["focused"].where("reason = 'first_frame'").orderBy("t").collect()
    assert [(r.video_id, r.start_t, r.t) for r in first] == [(0, 5.0, 5.0), (0, 40.0, 40.0)]
    only = focus.query_index(spark, str(tmp_path / "index.json"), None, ["key"], attention_only=True)["ranges"].collect()
    assert [(r.start_t, r.end_t) for r in only] == [(40.0, 50.0)]


def test_representatives_and_truth(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"representatives": [{"t": 2, "path": "b"}, {"t": 1.5, "path": "a"}]}')
    (tmp_path / "b.json").write_text('[{"t": 3.0}]')
    assert [r.t for r in readers.representatives(spark, str(tmp_path / "a.json")).collect()] == [1.5, 2.0]
    assert [r.t for r in readers.representatives(spark, str(tmp_path / "b.json")).collect()] == [3.0]
    (tmp_path / "gt.json").write_text('{"scenes": [{"start_s": 5, "end_s": 9, "desc": "y"}, {"start_s": 0, "end_s": 5, "desc": "x"}]}')
    (tmp_path / "none.json").write_text('{"scenes": []}')
    assert [r.desc for r in readers.ground_truth(spark, str(tmp_path / "gt.json")).collect()] == ["x", "y"]
    with pytest.raises(Exception, match="no scenes"):
        readers.ground_truth(spark, str(tmp_path / "none.json")).collect()
    assert len(readers.file_digests(spark, str(tmp_path), "a.json").first()["sha256"]) == 64


def test_late_rows_are_dropped(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "video_id long, type string, ts timestamp"
    for times in ([1, 3], [100], [101], [2], [200]):
        spark.createDataFrame([(1, "asr", at(s)) for s in times], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.windowed_counts(stream, 2.0, "10 seconds").writeStream.format("memory").queryName("late_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    live.run_until(q, 0.1)
    got = {(r.start.second, r.n) for r in spark.table("late_rows").collect() if r.start.minute == 0}
    assert got == {(0, 1), (2, 1)}


def test_vision():
    flat = np.full((48, 64, 3), 40, np.uint8)
    moved = flat.copy()
    moved[10:30, 20:40] = 220
    mask = vision.motion_mask(vision.gray(moved), vision.gray(flat))
    kept, ratio, gated = vision.boxes_of(mask)
    assert len(kept) == 1 and gated and kept[0][:2] == (19, 9) and 0.1 < ratio < 0.2
    two = np.zeros((20, 20), bool)
    two[2:6, 2:6] = two[10:18, 12:18] = True
    assert len(vision.regions(two)) == 2
    assert vision.pixel_percent(flat, flat) == 0 and vision.pixel_percent(flat, moved) > 1
    assert vision.perceptual_hash(moved) == vision.perceptual_hash(moved) != vision.perceptual_hash(moved[::-1])
    assert vision.color_histogram(moved).sum() == pytest.approx(1)
    assert vision.embed_input(moved, [0.5] * 3, [0.25] * 3).shape == (3, 224, 224)


def test_sources(spark, tmp_path):
    spark.dataSource.register(readers.FrameSource)
    frames = spark.read.format("frames").option("videos", 2).option("frames", 90).load()
    assert frames.count() == 180 and frames.agg(F.max("t")).first()[0] == pytest.approx(89 / 30)
    segs = sequences.motion_segments(vision.motion_frames(frames, 1.0))
    assert segs.count() == 2
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8_000)
        w.writeframes(np.repeat(np.arange(-8_000, 8_000, dtype="<i2"), 2).tobytes())
    chunks = readers.audio_chunks(spark, str(tmp_path)).orderBy("chunk").collect()
    assert [len(c["samples"]) // 4 for c in chunks] == [32_000]
    (tmp_path / "f.json").write_text('{"frames": [{"timestamp_sec": 1.5}, 2, {"x": 1}, {"t": "no"}]}')
    assert sorted(r["t"] for r in readers.frame_times(spark, str(tmp_path / "f.json")).collect()) == [0.0, 1.5, 2.0]


def test_plugins(spark):
    with pytest.raises(LookupError):
        plugins.backend("model", "absent")
    df = spark.createDataFrame([(1, "hello")], "id long, prompt string")
    assert "5 signs" in plugins.call(df, "model", "mock", "prompt", "reply").first()["reply"]
    m = plugins.ScriptedModel(["a", "b"], fail_next=1)
    with pytest.raises(ConnectionError):
        m("x")
    assert [m("x"), m("x"), m("x")] == ["a", "b", "b"]
