"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score(x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum is taken in
time linear in the features by 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Features: the words of the whole lower-cased text hashed to ``2**HASH_BITS`` columns (logarithm of
the count, each document's vector of length 1), standardised statistics of the text's structure,
and the number of characters that the table states (metadata). Labels, language, source and id are
never features. The model is fitted on the driver on at most ``SAMPLE`` labelled documents, which is
the one bounded sample; scoring reads every row and every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import bytesx
from tempora.llm.scratch import small_batches

HASH_BITS = 14
FACTORS = 8
SAMPLE = 8_000
EPOCHS = 12
#: A small sample is gone through more often, to this many steps.
LEAST_STEPS = 300
BATCH = 256
RATE = 0.02
DECAY = 1e-5
SEED = 11
#: Named as they are computed in ``structure``.
STATS = (
    "log_bytes", "log_words", "word_length", "distinct_share", "top_word_share", "repeat_share", "digit_share", "upper_share",
    "punctuation_share", "symbol_share", "bar_share", "wide_share", "log_lines", "line_words", "space_share", "symbol_end_share", "log_stated_chars",
)

_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_POINT = np.isin(np.arange(256), [ord(c) for c in ".,;:!?'\"()-"])
_BAR = np.arange(256) == ord("|")
_WIDE = np.arange(256) >= 128
_SPACE = np.isin(np.arange(256), bytesx.SPACES)
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_SYMBOL = ~(_DIGIT | _LETTER | _POINT | _BAR | _WIDE | _SPACE)


def features(text: pa.Array, stated: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, hashed columns, values, run starts, structure) of slices of rows."""
    for i, j, data, offsets in bytesx.slices(text):
        n = j - i
        small = bytesx.lower(data)
        starts, ends, counts = bytesx.words(data, offsets)
        h = bytesx.Runs(small)(starts, ends)
        doc = np.repeat(np.arange(n), counts)
        column = (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        key, times = np.unique(doc * (1 << HASH_BITS) + column, return_counts=True)
        owner, column = key >> HASH_BITS, key & ((1 << HASH_BITS) - 1)
        value = np.log1p(times)
        norm = np.sqrt(np.bincount(owner, value * value, minlength=n))
        value = value / np.maximum(norm, 1e-12)[owner]
        runs = np.searchsorted(owner, np.arange(n + 1))

        size = np.diff(offsets).astype(float)
        words = counts.astype(float)
        cum = lambda table: np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        share = lambda table: np.diff(cum(table)[offsets]) / np.maximum(size, 1)
        lines = np.diff(cum(np.arange(256) == 10)[offsets]) + 1.0
        top = np.zeros(n)
        np.maximum.at(top, owner, times)
        again = np.zeros(len(h), dtype=bool)
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        odd_end = _SYMBOL[data[ends - 1]] if len(ends) else np.zeros(0, dtype=bool)
        per_word = lambda flags: np.bincount(doc, flags, minlength=n) / np.maximum(words, 1)
        stats = np.column_stack([
            np.log1p(size), np.log1p(words), np.bincount(doc, ends - starts, minlength=n) / np.maximum(words, 1), np.diff(runs) / np.maximum(words, 1),
            top / np.maximum(words, 1), per_word(again), share(_DIGIT), share(_UPPER), share(_POINT), share(_SYMBOL), share(_BAR), share(_WIDE),
            np.log1p(lines), words / lines, share(_SPACE), per_word(odd_end), np.log1p(stated[i:j]),
        ])
        yield i, j, column, value, runs, stats


def _stated(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    x = np.asarray(column.cast(pa.float64()).fill_null(0.0))
    return np.where(np.isfinite(x) & (x > 0), x, 0.0)


class Machine:
    """A fitted model; ``constant`` holds the score where there was nothing to learn from."""

    def __init__(self, dense: int = len(STATS)):
        self.size = (1 << HASH_BITS) + dense
        self.bias, self.w = 0.0, np.zeros(self.size)
        self.v = np.random.default_rng(SEED).normal(0, 0.02, (self.size, FACTORS))
        self.mean, self.scale = np.zeros(dense), np.ones(dense)
        self.constant: float | None = None

    def join(self, column: np.ndarray, value: np.ndarray, runs: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashed and structural features in one sparse form: columns, values, row of each."""
        rows, dense = stats.shape
        z = np.clip((stats - self.mean) / self.scale, -5, 5) / np.sqrt(dense)
        row = np.concatenate((np.repeat(np.arange(rows), np.diff(runs)), np.repeat(np.arange(rows), dense)))
        col = np.concatenate((column, np.tile(np.arange(dense) + (1 << HASH_BITS), rows)))
        return col, np.concatenate((value, z.ravel())), row

    def logits(self, col: np.ndarray, val: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        linear = np.bincount(row, self.w[col] * val, minlength=rows)
        sums, pair = np.empty((rows, FACTORS)), np.zeros(rows)
        for f in range(FACTORS):
            vx = self.v[col, f] * val
            sums[:, f] = np.bincount(row, vx, minlength=rows)
            pair += sums[:, f] ** 2 - np.bincount(row, vx * vx, minlength=rows)
        return self.bias + linear + 0.5 * pair, sums

    def scores(self, *x: np.ndarray) -> np.ndarray:
        rows = len(x[3])
        if self.constant is not None:
            return np.full(rows, self.constant)
        z, _ = self.logits(*self.join(*x), rows)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
        """``examples``: (columns, values, structure) of each document. Adam on the logistic loss."""
        if len(labels) == 0 or labels.min() == labels.max():
            self.constant = float((labels.sum() + 1) / (len(labels) + 2)) if len(labels) else 0.5
            return self
        stats = np.stack([e[2] for e in examples])
        self.mean, self.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
        share = labels.mean()
        self.bias = float(np.log(share / (1 - share)))
        rng = np.random.default_rng(SEED)
        m = {k: (np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))) for k in ("w", "v")}
        step = 0
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(len(labels), BATCH)))):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                runs = np.concatenate(([0], np.cumsum([len(examples[i][0]) for i in pick])))
                col, val, row = self.join(
                    np.concatenate([examples[i][0] for i in pick]), np.concatenate([examples[i][1] for i in pick]), runs, stats[pick]
                )
                z, sums = self.logits(col, val, row, len(pick))
                err = (1 / (1 + np.exp(-z)) - labels[pick]) / len(pick)
                self.bias -= RATE * err.sum()
                g = err[row] * val
                used, back = np.unique(col, return_inverse=True)
                gw = np.bincount(back, g, minlength=len(used)) + DECAY * self.w[used]
                gv = np.empty((len(used), FACTORS))
                for f in range(FACTORS):
                    gv[:, f] = np.bincount(back, g * (sums[row, f] - self.v[col, f] * val), minlength=len(used))
                gv += DECAY * self.v[used]
                step += 1
                for name, grad in (("w", gw), ("v", gv)):
                    first, second = m[name]
                    first[used] = 0.9 * first[used] + 0.1 * grad
                    second[used] = 0.999 * second[used] + 0.001 * grad * grad
                    getattr(self, name)[used] -= RATE * (first[used] / (1 - 0.9**step)) / (np.sqrt(second[used] / (1 - 0.999**step)) + 1e-8)
        return self


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled documents, chosen by a hash of their id.

    ``labels`` has doc_id and label (0 or 1). Null ids or labels take no part; an id labelled more
    than once counts by its least label, an id that several documents have by each of them up to
    the bound. Without labels of both kinds the score is a constant.
    """
    ids = (
        labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    stated = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None).cast("long").alias("n_chars")
    rows = docs.select("doc_id", "text", stated).join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text", "n_chars")

    def extract(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            stated = _stated(t["n_chars"])
            for i, j, column, value, runs, stats in features(t["text"].combine_chunks(), stated):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": t["doc_id"].combine_chunks()[i:j], "label": t["label"].combine_chunks().cast(pa.int32())[i:j],
                    "col": bytesx.binaries(column.astype(np.int32).view(np.uint8), runs * 4), "val": bytesx.binaries(value.astype(np.float32).view(np.uint8), runs * 4),
                    "stats": bytesx.binaries(stats.astype(np.float64).view(np.uint8).ravel(), np.arange(j - i + 1) * 8 * len(STATS)),
                })

    got = rows.mapInArrow(extract, "doc_id long, label int, col binary, val binary, stats binary").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("stats", "ascending")]).slice(0, sample)
    examples = [
        (np.frombuffer(c, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float), np.frombuffer(s, np.float64))
        for c, v, s in zip(got["col"].to_pylist(), got["val"].to_pylist(), got["stats"].to_pylist(), strict=True)
    ]
    return Machine().fit(examples, np.array(got["label"].to_pylist(), dtype=float))


def score(spark: SparkSession, docs: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; null and empty texts have one too.

    A column of that name is replaced. Other columns may have any names.
    """
    small_batches(spark)
    docs = docs.drop(column)
    model = spark.sparkContext.broadcast(machine)
    stated = "n_chars" if "n_chars" in docs.columns else None

    def run(batches):
        fitted = model.value
        for b in batches:
            t = pa.Table.from_batches([b])
            lengths = _stated(t[stated]) if stated else np.zeros(len(t))
            out = np.empty(len(t))
            for i, j, *x in features(t["text"].combine_chunks(), lengths):
                out[i:j] = fitted.scores(*x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, column])

    schema = docs.select("*").withColumn(column, F.lit(0.0)).schema
    return docs.mapInArrow(run, schema)
