"""Plug-ins: embedders, labelers, readers, recognisers, language models. Only mocks are built in.

A backend that is not there is an explicit error, never a silent fallback.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_registry: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    """Name a factory; it is called once for each worker's stream of batches."""

    def keep(factory: Callable) -> Callable:
        _registry[kind, name] = factory
        return factory

    return keep


def backend(kind: str, name: str) -> Callable:
    if (kind, name) not in _registry:
        known = sorted(n for k, n in _registry if k == kind)
        raise LookupError(f"no {kind} backend {name!r}; there are {known}")
    return _registry[kind, name]


class ScriptedModel:
    """A test double: replies in turn, repeats the last one, and fails the next ``fail_next`` calls."""

    def __init__(self, replies: list[str], fail_next: int = 0):
        self.replies, self.fail_next, self.calls = list(replies), fail_next, 0

    def __call__(self, prompt: str) -> str:
        self.calls += 1
        if self.fail_next:
            self.fail_next -= 1
            raise ConnectionError("scripted failure")
        return self.replies.pop(0) if len(self.replies) > 1 else self.replies[0]


@register("model", "mock")
def _mock_model() -> Callable[[str], str]:
    return lambda prompt: '{"segment": {"summary": "' + str(len(prompt)) + ' signs"}}'


def call(rows: DataFrame, kind: str, name: str, column: str, into: str, retries: int = 3) -> DataFrame:
    """``rows`` with the backend's answer for ``column``; after ``retries`` failures null, with the error in ``<into>_error``."""
    factory = backend(kind, name)
    schema = f"{rows.schema.simpleString()[7:-1]}, {into} string, {into}_error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = factory()
        for pdf in batches:
            answers, errors = [], []
            for x in pdf[column]:
                answer = error = None
                for _ in range(retries):
                    try:
                        answer, error = ask(x), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                answers.append(answer)
                errors.append(error)
            yield pdf.assign(**{into: answers, f"{into}_error": errors})

    return rows.mapInPandas(run, schema)


@register("embedder", "mock")
def _mock_embedder():
    return (lambda x: [float(len(x)), float(sum(x) % 251)],)


@register("reader", "mock")
def _mock_reader():
    return lambda x: [[None, line, len(line) % 100 / 100] for line in bytes(x).decode("utf-8", "replace").split("\n")]


@register("recogniser", "mock")
def _mock_recogniser():
    return lambda samples, rate: f"{len(samples)} samples"


def _tabled(rows: DataFrame, kind: str, name: str, out: str, each: Callable) -> DataFrame:
    """``out`` rows that ``each(backend, row)`` lists; the backend is made once for each stream of batches."""
    factory, names = backend(kind, name), [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = factory()
        for pdf in batches:
            yield pd.DataFrame([x for row in pdf.itertuples(index=False) for x in each(b, row)], columns=names)

    return rows.mapInPandas(run, out)


def embed(rows: DataFrame, name: str) -> DataFrame:
    """(video_id, seq, v) of (video_id, seq, content). A backend has ``embed``, or is a tuple that begins with that function."""

    def each(b, row):
        f = b[0] if isinstance(b, tuple) and b else getattr(b, "embed", None)
        if not callable(f):
            raise TypeError(f"an embedder has embed() or is a tuple of functions, not {type(b).__name__}")
        return [(row.video_id, row.seq, [float(x) for x in f(row.content)])]

    return _tabled(rows, "embedder", name, "video_id long, seq long, v array<double>", each)


def read_text(rows: DataFrame, name: str) -> DataFrame:
    """(video_id, seq, item, t, text, conf) of (video_id, seq, t, content): what the reader finds, in its order; blank text goes."""

    def each(b, row):
        found = (b(row.content) if row.content is not None and len(row.content) else None) or []
        return [(row.video_id, row.seq, k, round(float(row.t), 3), str(x[1]).strip(), round(float(x[2]), 4)) for k, x in enumerate(found) if str(x[1]).strip()]

    return _tabled(rows, "reader", name, "video_id long, seq long, item long, t double, text string, conf double", each)


def transcribe(rows: DataFrame, name: str, seconds: float = 15.0, rate: int = 16_000) -> DataFrame:
    """(video_id, t, text) of (video_id, samples: float32 bytes): windows of fixed length; one under 0.2 s ends it, blank text goes."""
    step = int(rate * seconds) or rate

    def each(b, row):
        x = np.frombuffer(row.samples or b"", np.float32)
        for k in range(0, len(x), step):
            if len(x[k : k + step]) < rate * 0.2:
                return
            text = b(x[k : k + step], rate).strip()
            if text:
                yield row.video_id, round(k / rate, 3), text

    return _tabled(rows, "recogniser", name, "video_id long, t double, text string", each)
