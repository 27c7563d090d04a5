"""Representatives: greedy anchored buckets, diversity within a bucket, deduplication, budgets.

Buckets depend on where earlier ones began, so each timeline is folded in order (WIN1, WIN4); distances are over
feature vectors, computed in numpy for the bucket at hand, so memory is one bucket, not one timeline.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators.fold import Steps, folded
from tempora.schema import SelectConfig

Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]


def cosine(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    """1 - cosine of each row with ``one``; 0 where either is zero."""
    norm = np.linalg.norm(points, axis=1) * np.linalg.norm(one)
    return np.where(norm == 0, 0.0, 1 - points @ one / np.where(norm == 0, 1, norm))


def greedy_starts(t: np.ndarray, interval: float) -> np.ndarray:
    """The start of each row's bucket: 0 first; a row at or past start + interval opens one at its own time."""
    out, start = np.empty(len(t)), 0.0
    for i, x in enumerate(t):
        if x >= start + interval:
            start = x
        out[i] = start
    return out


def greedy_buckets(rows: DataFrame, interval: float) -> DataFrame:
    """Rows with the start of their bucket."""

    names = rows.columns

    def start() -> Steps:
        begin = [0.0]

        def step(r) -> list[tuple]:
            if r.t >= begin[0] + interval:
                begin[0] = r.t
            return [(*(getattr(r, n) for n in names), begin[0])]

        return Steps(step)

    return folded(rows, start, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", bucket double")


def pixel_percent(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Mean absolute difference of small pictures in percent of full scale."""
    return np.abs(points - one).mean(axis=1) / 255 * 100


def farthest(points: np.ndarray, k: int, distance: Distance = cosine) -> tuple[list[int], list[float]]:
    """Farthest-point choice of k rows: first the one farthest from row 0, then the farthest from all chosen."""
    d0 = distance(points, points[0])
    first = int(np.argmax(d0))
    chosen, scores = [first], [float(d0[first])]
    near = distance(points, points[first])
    while len(chosen) < min(k, len(points)):
        near[chosen] = -np.inf
        nxt = int(np.argmax(near))
        chosen.append(nxt)
        scores.append(float(near[nxt]))
        near = np.minimum(near, distance(points, points[nxt]))
    return chosen, scores


class _Buckets:
    """The open bucket of one timeline: rows (video_id, seq, t, v[, pixels])."""

    def __init__(self, c: SelectConfig, adaptive: bool):
        self.c, self.adaptive, self.start, self.width, self.rows = c, adaptive, 0.0, c.interval, []

    def step(self, r) -> list[tuple]:
        out = []
        if r.t >= self.start + self.width:
            out = self.end()
            self.start = r.t
        self.rows.append(r)
        return out

    def end(self) -> list[tuple]:
        rows, c = self.rows, self.c
        if not rows:
            return []
        v = np.stack([np.asarray(r.v, float) for r in rows])
        pixels = np.stack([np.asarray(r.pixels, float) for r in rows]) if hasattr(rows[0], "pixels") else None

        def apart(place: np.ndarray, one: np.ndarray) -> np.ndarray:
            some, i = place[:, 0].astype(int), int(one[0])
            semantic = cosine(v[some], v[i])
            return semantic if pixels is None else c.pixel_weight * pixel_percent(pixels[some], pixels[i]) / 100 + (1 - c.pixel_weight) * semantic

        chosen, scores = farthest(np.arange(len(rows), dtype=float)[:, None], c.k, apart)
        out = [(rows[p].video_id, rows[p].seq, rows[p].t, self.start, s) for p, s in sorted(zip(chosen, scores, strict=True))]
        if self.adaptive:
            spread = float((pixel_percent(pixels, pixels[0]) if pixels is not None else 100 * cosine(v, v[0])).max())
            if spread < c.grow_below:
                self.width = min(self.width * 2, 4 * c.interval)
            elif spread > c.shrink_above:
                self.width = max(self.width / 2, 0.5 * c.interval)
        self.rows = []
        return out


def representatives(rows: DataFrame, config: SelectConfig = SelectConfig(), *, adaptive: bool = False) -> DataFrame:
    """(video_id, seq, t, bucket, score): k diverse rows of each greedy bucket.

    Rows differ by their vectors ``v`` (cosine), or, with small pictures in ``pixels``, by pixels and vectors
    weighed by ``pixel_weight``. Adaptive buckets double (up to 4 intervals) when in the closed one no picture differed
    from the first by ``grow_below`` percent, and halve (down to half an interval) when one did by more than ``shrink_above``; a
    bucket of one row did not vary.
    """
    return folded(rows, lambda: _Buckets(config, adaptive), "video_id long, seq long, t double, bucket double, score double")


def drop_similar(rows: DataFrame, least: float, distance: Distance = cosine) -> DataFrame:
    """Rows that differ by ``least`` or more from the last row kept (not from the one before)."""

    def start() -> Steps:
        last: list[np.ndarray] = []

        def step(r) -> list[tuple]:
            v = np.asarray(r.v, dtype=float)
            if last and distance(v[None, :], last[0])[0] < least:
                return []
            last[:] = [v]
            return [(r.video_id, r.seq, r.t)]

        return Steps(step)

    return folded(rows, start, "video_id long, seq long, t double")


def budget_interval(count: Callable[[float], int], span: float, most: int, tries: int = 5) -> float:
    """The bucket width after at most five attempts to give ``most`` representatives; it may still give more."""
    interval = max(1.0, span / most)
    for _ in range(tries):
        n = count(interval)
        if n <= most:
            break
        interval = round(interval * (n / most) ** 1.1, 1) + 0.1
    return interval


def within_budget(rows: DataFrame, most: int) -> tuple[DataFrame, float]:
    """Greedy representatives of all timelines with a width for ``most`` of them; features are read once a try."""
    span = rows.agg((F.max("t") - F.min("t")).alias("s")).first()["s"] or 0.0
    count = lambda w: greedy_buckets(rows.select("video_id", "seq", "t"), w).select("video_id", "bucket").distinct().count()
    width = budget_interval(count, span, most)
    return representatives(rows, SelectConfig(interval=width)), width
