"""Folds over timelines: rows in order of (t, seq), the state of one timeline at a time in memory.

Timelines are dealt by ``video_id`` and sorted within their partition, so a task streams them in batches, whatever
their length; only what a state keeps is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class State(Protocol):
    def step(self, row) -> list[tuple]: ...

    def end(self) -> list[tuple]: ...


class Steps:
    """A state from one step function that gives the rows of one row."""

    def __init__(self, step: Callable[[object], list[tuple]]):
        self.step = step

    def end(self) -> list[tuple]:
        return []


def folded(rows: DataFrame, start: Callable[[], State], schema: str, order: tuple[str, ...] = ("t", "seq")) -> DataFrame:
    """The rows that each timeline's state gives, step by step and at its end; ``schema`` names their columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in pdfs:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False):
                if state is None or row.video_id != key:
                    out += state.end() if state is not None else []
                    key, state = row.video_id, start()
                out += state.step(row)
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame(state.end(), columns=names)

    return rows.repartition("video_id").sortWithinPartitions("video_id", *order).mapInPandas(run, schema)
