"""Streaming twins: the same step functions over keyed state, so that batch and stream give the same rows.

One ordered stream per timeline is keyed by ``video_id``; state is bounded by construction (one open
segment, rings of fixed length, one pending window).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tempora.operators.fold import Steps, folded
from tempora.operators.sequences import KeyframeState
from tempora.schema import MotionConfig

LABELS, ASR = 50, 30


def _stateful(rows: DataFrame, step: Callable[[dict, dict], list[dict]], start: Callable[[], dict], schema: str) -> DataFrame:
    """Fold ``step(state, row)`` over each timeline; state travels as JSON and survives restarts with the checkpoint."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else start()
        out: list[dict] = []
        for row in pd.concat(list(pdfs)).sort_values(["t", "seq"]).to_dict("records"):
            out += [{"video_id": key[0], **x} for x in step(state, row)]
        held.update((json.dumps(state),))
        names = [c.split()[0] for c in schema.split(", ")]
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy("video_id").applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


_LOOP = re.compile(r"(.{1,4})\1{2,}")


def clean_step(state: dict, row: dict) -> list[dict]:
    """The batch cleaner's rule: loops fold, empty texts and repeats of the last text given go."""
    raw = row["text"] or ""
    stripped = raw.strip()
    text = _LOOP.sub(r"\1", stripped)
    if not text or text == state.get("last"):
        return []
    state["last"] = text
    return [{"seq": row["seq"], "t": row["t"], "text": text, "raw_text": raw if text != stripped else None}]


def clean(rows: DataFrame) -> DataFrame:
    return _stateful(rows, clean_step, dict, "video_id long, seq long, t double, text string, raw_text string")


def align_step(state: dict, row: dict, tail: float = 2.0) -> list[dict]:
    """Segment i closes when segment i + 1 comes, with all events of its window that have come by then.

    Events wait in the state until the segment after them begins: speech lags behind pictures, so those of a segment
    may come before it. An ``end`` row closes the last segment, at its own end or ``tail`` after its start.
    """
    out: list[dict] = []
    pending, kind = state.get("pending"), row["type"]
    if kind == "asr":
        if pending:
            out.append(_closed(state, row["t"]))
        end = row.get("end_t")
        state["pending"] = {"seq": row["seq"], "t": row["t"], "end": None if end is None or end != end else end}
        state["events"] = [e for e in state.get("events", []) if e[0] >= row["t"]]
    elif kind == "end":
        out += flush_align(state, tail)
    elif kind.startswith("motion") or kind == "keyframe":
        state.setdefault("events", []).append([row["t"], kind])
    return out


def _closed(state: dict, end: float) -> dict:
    p = state["pending"]
    held = [kind for t, kind in state.get("events", []) if p["t"] <= t < end]
    motion = [k for k in held if k.startswith("motion")]
    return {
        "seq": p["seq"], "t0": p["t"], "t1": end, "linked_motion_events": len(motion), "linked_keyframes": held.count("keyframe"),
        "motion_types": ",".join(sorted(set(motion))),
    }


def align(events: DataFrame, tail: float = 2.0) -> DataFrame:
    """Closed segments as they close; a timeline's last one leaves with its ``end`` row (see ``flush_align``)."""
    schema = "video_id long, seq long, t0 double, t1 double, linked_motion_events long, linked_keyframes long, motion_types string"
    return _stateful(events, lambda state, row: align_step(state, row, tail), dict, schema)


def flush_align(state: dict, tail: float) -> list[dict]:
    """The pending segment, closed at its end or by its tail; once."""
    p = state.get("pending")
    out = [_closed(state, p["t"] + tail if p.get("end") is None else p["end"])] if p else []
    state["pending"] = None
    return out


def keyframes(frames: DataFrame, config: MotionConfig = MotionConfig()) -> DataFrame:
    """The batch acceptor's own step over a stream."""
    settings = asdict(config)

    def step(state: dict, row: dict) -> list[dict]:
        k = KeyframeState(MotionConfig(**settings))
        for name, value in state.items():
            setattr(k, name, [tuple(x) for x in value] if name == "soft" else value)
        why = k.step(row["t"], row["grey"], int(row["phash"]) & ((1 << 64) - 1), row["hist"], row["motion"])
        state |= {n: getattr(k, n) for n in ("last_t", "grey", "hist", "hashes", "over", "soft")}
        return [{"seq": row["seq"], "t": row["t"], "reason": why}] if why else []

    return _stateful(frames, step, dict, "video_id long, seq long, t double, reason string")


@dataclass
class Trigger:
    """When gathered material is due for understanding: on keyframes (not the first), long motion, or speech.

    At least ``floor`` seconds pass between fires. Under suspected ego-motion a keyframe or a long motion is kept but
    asks for nothing, until the suspicion has lasted ``defer`` seconds (0: for as long as it lasts). Motion alone opens
    no window. Material merges while it waits: the newest ``most`` keyframes, the last ``chars`` signs of speech.
    """

    floor: float = 8.0
    motion: float = 2.0
    defer: float = 30.0
    most: int = 10
    retries: int = 3
    chars: int = 4000
    speech: bool = True
    last: float | None = None
    since: float | None = None
    due: bool = False
    window: dict = field(default_factory=lambda: empty_window())
    dropped: int = 0

    def _asks(self, row: dict) -> bool:
        if not row.get("ego_suspect"):
            self.since = None
            return True
        if self.defer <= 0:
            return False
        if self.since is None:
            self.since = row["t"]
            return False
        if row["t"] - self.since < self.defer:
            return False
        self.since = None
        return True

    def step(self, row: dict, hold: bool = False, again: bool = False) -> dict | None:
        """Take a row in; the window if it fires, which ``hold`` forbids. ``again`` is a retry, outside the floor."""
        kind, t, w = row["type"], row["t"], self.window
        if kind == "keyframe":
            w["kf"] = sorted({*map(tuple, w["kf"]), (t, row.get("path") or "")})[-self.most :]
            self._reaches(t, t)
            if row.get("reason") != "first_frame" and self._asks(row):
                self.due = True
        elif kind == "motion_end":
            w["motion_n"] += 1
            if (row.get("duration") or 0) >= self.motion and self._asks(row):
                self.due = True
        elif kind == "asr":
            w["asr"] = joined(w["asr"], row.get("text"), self.chars)
            end = row.get("end_t")
            self._reaches(t, t if end is None or end != end else end)
            self.due |= self.speech
        return None if hold else self.fire(t, again)

    def _reaches(self, start: float, end: float) -> None:
        w = self.window
        w["t0"], w["t1"] = start if w["t0"] is None else w["t0"], max(w["t1"], end)

    def fire(self, t: float, again: bool = False) -> dict | None:
        """The window, if it is due and the floor allows it; what is due without material is forgotten."""
        if not self.due or (not again and self.last is not None and t - self.last < self.floor):
            return None
        self.due = False
        if self.window["t0"] is None:
            return None
        w, self.window = self.window, empty_window()
        self.last = self.last if again else t
        return {"t": t, **w}

    def merged(self, old: dict, new: dict) -> dict:
        starts = [w["t0"] for w in (old, new) if w["t0"] is not None]
        return {
            "kf": sorted({*map(tuple, old["kf"]), *map(tuple, new["kf"])})[-self.most :], "asr": joined(old["asr"], new["asr"], self.chars),
            "motion_n": old["motion_n"] + new["motion_n"], "retries": max(old["retries"], new["retries"]), "t0": min(starts, default=None), "t1": max(old["t1"], new["t1"]),
        }

    def failed(self, window: dict) -> bool:
        """Merge a window back for another try (true), or count it as dropped."""
        if window["retries"] >= self.retries:
            self.dropped += 1
            return False
        self.window, self.due = self.merged(window | {"retries": window["retries"] + 1}, self.window), True
        return True


def empty_window() -> dict:
    return {"kf": [], "asr": "", "motion_n": 0, "retries": 0, "t0": None, "t1": 0.0}


def joined(text: str, more: str | None, chars: int) -> str:
    return f"{text} {more}".strip()[-chars:] if more else text


def answer(text: str | None) -> str:
    """``now`` of a reply in JSON; of any other reply the first 120 signs."""
    found = re.search(r"(?s)\{.*\}", text or "")
    try:
        reply = json.loads(found.group(0)) if found else None
    except ValueError:
        reply = None
    return str(reply.get("now") or "") if isinstance(reply, dict) else (text or "").strip()[:120]


UNDERSTOOD = "video_id long, seq long, t double, t0 double, t1 double, keyframes long, motion_n long, retries long, now string, error string"


def understanding_step(state: dict, row: dict, ask: Callable[[str, list], str] | None, settings: dict) -> list[dict]:
    """One row for each call of the model, answered or failed; a failed window waits for its backoff and merges with what comes.

    While one waits, none is fired. Without a model, material only passes by. Clocks are event times.
    """
    if ask is None:
        return []
    trigger = Trigger(**settings)
    for name in ("last", "since", "due", "window", "dropped"):
        setattr(trigger, name, state.get(name, getattr(trigger, name)))
    t, waits, out = row["t"], state.get("waits"), []
    row = {k: None if isinstance(v, float) and v != v else v for k, v in row.items()}
    window = trigger.step(row, hold=waits is not None and t < waits, again=waits is not None)
    if window is not None:
        told = {"seq": row["seq"], "t": t, "t0": window["t0"], "t1": window["t1"], "keyframes": len(window["kf"]), "motion_n": window["motion_n"], "retries": window["retries"]}
        state["waits"] = None
        try:
            out = [{**told, "now": answer(ask(window["asr"], window["kf"])), "error": None}]
            state["streak"] = 0
        except Exception as e:
            state["streak"] = state.get("streak", 0) + 1
            if trigger.failed({k: v for k, v in window.items() if k != "t"}):
                state["waits"] = t + min(60.0, 2.0 ** state["streak"])
            out = [{**told, "now": None, "error": f"{type(e).__name__}: {e}"}]
    state |= {n: getattr(trigger, n) for n in ("last", "since", "due", "window", "dropped")}
    return out


def understanding(events: DataFrame, model: Callable[[], Callable[[str, list], str]] | None, **settings) -> DataFrame:
    """The loop as a stream over (video_id, seq, t, type, ...); ``model`` makes the callable, once for each worker's state.

    Its rows are events of type ``understanding`` again if published with ``feedback``.
    """
    return _stateful(events, lambda state, row: understanding_step(state, row, model() if model else None, settings), dict, UNDERSTOOD)


def understood(events: DataFrame, model: Callable[[], Callable[[str, list], str]] | None, **settings) -> DataFrame:
    """The same loop over a table."""
    names = [c.split()[0] for c in UNDERSTOOD.split(", ")]

    def start() -> Steps:
        state: dict = {}
        ask = model() if model else None

        def step(r) -> list[tuple]:
            return [(r.video_id, *(x[n] for n in names[1:])) for x in understanding_step(state, r._asdict(), ask, settings)]

        return Steps(step)

    return folded(events, start, UNDERSTOOD)


def feedback(results: DataFrame) -> DataFrame:
    """Answers as events (video_id, seq, t, type, text), at the end of the window that they speak of."""
    return results.where("error is null").selectExpr("video_id", "seq", "t1 as t", "'understanding' as type", "now as text")


def windowed_counts(events: DataFrame, seconds: float, late: str) -> DataFrame:
    """Events by timeline, type and tumbling window of ``ts``; those older than the watermark ``late`` are dropped and counted by Spark."""
    from pyspark.sql import functions as F

    kept = events.withWatermark("ts", late).groupBy("video_id", "type", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return kept.select("video_id", "type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_until(query, seconds: float | None = None) -> None:
    """Wait for a query; an interrupt or the end of the time stops it, and what it wrote and its checkpoint stay."""
    try:
        query.awaitTermination(seconds)
    except KeyboardInterrupt:
        pass
    finally:
        query.stop()


def session_step(state: dict, row: dict) -> list[dict]:
    """Rolling session state: newest labels and speech, counts, entities (last write wins) and lags."""
    state.setdefault("labels", [])
    state.setdefault("asr", [])
    state.setdefault("entities", {})
    state["events"] = state.get("events", 0) + 1
    state["t_now"] = max(state.get("t_now", row["t"]), row["t"])
    if row["type"] == "tag":
        state["labels"] = [*state["labels"], [row["t"], row.get("text")]][-LABELS:]
    elif row["type"] == "asr":
        state["asr"] = [*state["asr"], [row["t"], row.get("text")]][-ASR:]
        state["t_asr"] = row["t"]
    lag = None if "t_asr" not in state else round(max(0.0, state["t_now"] - state["t_asr"]), 2)
    return [{"t_now": state["t_now"], "events": state["events"], "labels": len(state["labels"]), "asr": len(state["asr"]), "asr_lag": lag}]


def sessions(events: DataFrame) -> DataFrame:
    """A snapshot of the session's state after every event; the newest per timeline is its state."""
    return _stateful(events, session_step, dict, "video_id long, t_now double, events long, labels long, asr long, asr_lag double")


def snapshots(stream: DataFrame, path: str, checkpoint: str, seconds: float = 1.0):
    """Write every batch's newest row of each timeline, whole or not at all."""
    from pyspark.sql import functions as F

    def put(batch: DataFrame, k: int) -> None:
        newest = batch.groupBy("video_id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "video_id"]), F.struct("t_now", "events")).alias("s"))
        newest.select("video_id", "s.*").write.mode("overwrite").json(f"{path}/batch={k}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds")
