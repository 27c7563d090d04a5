"""Soft-membership mixing to target token totals, in DataFrame functions only.

1. A classifier predicts each document's posterior over domains. It is learned from a bounded sample of
   labelled rows: words of the whole text and their endings (the last two signs) are hashed
   to BUCKETS buckets, and buckets in which a domain's documents differ beyond chance weigh by their log odds. Sums
   of these weights and a few counts are the inputs of a softmax regression (see ``INPUTS``).
2. Nonnegative rates r_d solve min 1/2 sum_k (sum_d r_d n_d p_dk - T_k)^2 / (N s_k) + PULL/2 sum_d n_d (r_d - c_d)^2,
   where n are tokens, p posteriors, T targets, N all tokens and s_k the larger of the domain's share of them and its
   target's (a domain that hardly any document may belong to misses its target, and moves no other). The centre c is 1, and in
   each of the ROUNDS after the first the rates of the one before (proximal steps), so that little of what the pull
   takes from the targets is left while every round stays well conditioned. Documents whose
   posteriors agree when rounded to 1/GRID share a rate; such a cell has their tokens and exact expected domain
   tokens, so rounding moves no total, and there are at most (GRID+3)(GRID+2)(GRID+1)/6 cells (176,851) however
   large the corpus. Each projected-gradient step is one distributed sum over the cells' table. Its length is that of
   Barzilai and Borwein, which the sums give without another pass; where the loss has risen a plain step follows,
   which never raises it. Steps end when the projected gradient, in the mean square over tokens, is at most TOLERANCE.
   Rates may have an upper bound too (1: no document is repeated). A stronger pull in a single round keeps more of
   what is unlikely to belong to an unwanted domain, and misses the targets by more.
3. A document's rate is its cell's, and its copies are the rate rounded up or down by a hash of its id and text,
   with the rate as expectation.

What reaches the driver: counts of BUCKETS buckets, INPUTS of at most SAMPLE labelled rows, and a few sums for each step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.scratch import fresh, settled, small_batches, stash

SAMPLE = 8_000
BUCKETS = 1 << 15
#: Least documents of a domain that hold a bucket, and standard errors between its shares, for a weight.
SUPPORT, BEYOND_CHANCE = 4, 4.0
GRID = 100
STEPS = 400
PULL, ROUNDS = 0.02, 3
TOLERANCE = 1e-4
#: A domain is a pair of labels (quality, toxic).
DOMAINS = {"clean": (1, 0), "toxic": (1, 1), "low": (0, 0), "low_toxic": (0, 1)}
#: Weights tell toxic documents from others, and low ones from others.
CONTRASTS = {"toxic": (1, 3), "low": (2, 3)}
#: What the regression sees; for each contrast the sum of weights, whether any is high, and how many are.
INPUTS = ("one", "toxic_sum", "toxic_any", "toxic_many", "low_sum", "low_any", "low_many", "log_words", "distinct_share", "digits", "repeats", "wordless")
HIGH = 1.0
_SPACE = r"[\x20\x09-\x0D]+"
_SEED = 29


def _body() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _cut(c: Column) -> Column:
    return F.array_remove(F.split(c, _SPACE), "")


def _with_words(rows: DataFrame) -> DataFrame:
    """``_w``: the words of the whole lower-cased text; ``n_tokens``: their number; ``_b``: distinct buckets of words and endings."""
    bucket = lambda seed: lambda x: F.pmod(F.xxhash64(F.lit(seed), x), F.lit(BUCKETS)).cast("int")
    return (
        rows.withColumn("_w", _cut(F.lower(_body()))).withColumn("n_tokens", F.size("_w").cast("long"))
        .withColumn("_d", F.array_distinct("_w"))
        .withColumn("_b", F.array_union(F.transform("_d", bucket(_SEED)), F.transform(F.transform("_d", lambda x: F.right(x, F.lit(2))), bucket(_SEED + 1))))
    )


def _tenths_of(contrast: int):
    return lambda code: F.pmod(F.floor(code / 200**contrast), F.lit(200)).cast("int") - 100


class Classifier:
    """Bucket weights, one row for each contrast, and the regression's coefficients, one row for each domain."""

    def __init__(self, weights: np.ndarray, beta: np.ndarray):
        self.weights, self.beta = weights, beta

    def codes(self) -> np.ndarray:
        """One number for each bucket: its weights in tenths, shifted to 1 to 199 and written side by side; 0 without weights."""
        tenths = np.clip(np.round(self.weights * 10), -99, 99).astype(int)
        return np.where((tenths != 0).any(axis=0), sum((t + 100) * 200**k for k, t in enumerate(tenths)), 0)

    def inputs(self, rows: DataFrame) -> DataFrame:
        """``_x``: the INPUTS of each row; what they were made of goes."""
        codes = F.split(F.lit(",".join(map(str, self.codes().tolist()))), ",").cast("array<int>")
        rows = rows.withColumn("_m", F.filter(F.transform("_b", lambda b: F.element_at(codes, b + 1)), lambda c: c > 0))
        cells: list[Column] = [F.lit(1.0)]
        for k in range(len(CONTRASTS)):
            tenths = F.transform("_m", _tenths_of(k))
            total = F.aggregate(tenths, F.lit(0), lambda a, x: a + x) / 10.0
            high = F.size(F.filter(tenths, lambda x: x > HIGH * 10))
            cells += [F.least(F.greatest(total, F.lit(-15.0)), F.lit(30.0)) / 10, F.least(high, F.lit(1)).cast("double"), F.least(high, F.lit(8)) / 8]
        n = F.greatest(F.col("n_tokens"), F.lit(1)).cast("double")
        digits = F.length(_body()) - F.length(F.translate(_body(), "0123456789", ""))
        repeats = F.size(F.filter("_w", lambda x, i: (i > 0) & (x == F.get("_w", i - 1))))
        cells += [
            F.log2(n + 1) / 10, F.size("_d") / n, F.least(digits / n, F.lit(2.0)), repeats / n, (F.col("n_tokens") == 0).cast("double"),
        ]
        return rows.withColumn("_x", F.array(*cells)).drop("_w", "_d", "_b", "_m")

    def posterior(self) -> list[Column]:
        """The posterior over DOMAINS, from ``_x``; sums to 1."""
        logit = [sum((F.col("_x")[i] * float(c) for i, c in enumerate(row) if c), F.lit(0.0)) for row in self.beta]
        return [F.lit(1.0) / sum((F.exp(F.least(other - mine, F.lit(50.0))) for other in logit), F.lit(0.0)) for mine in logit]


def _bucket_weights(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log odds of each bucket for each contrast, 0 where the difference may be chance. ``counts`` is (BUCKETS, domains)."""
    out = np.zeros((len(CONTRASTS), len(counts)))
    for c, rare in enumerate(CONTRASTS.values()):
        inside, n_in = counts[:, rare].sum(axis=1), sizes[list(rare)].sum()
        outside, n_out = counts.sum(axis=1) - inside, sizes.sum() - n_in
        if not n_in or not n_out:
            continue
        both = (inside + outside) / (n_in + n_out)
        error = np.sqrt(np.maximum(both * (1 - both) * (1 / n_in + 1 / n_out), 1e-12))
        odds = np.log((inside + 0.5) / (n_in + 1)) - np.log((outside + 0.5) / (n_out + 1))
        out[c] = np.where((np.abs(inside / n_in - outside / n_out) >= BEYOND_CHANCE * error) & (inside + outside >= SUPPORT), odds, 0)
    return out


def _regression(x: np.ndarray, k: np.ndarray, steps: int = 1_500) -> np.ndarray:
    """Softmax coefficients by gradient descent with momentum; without rows every domain is as likely."""
    beta = np.zeros((len(DOMAINS), len(INPUTS)))
    if not len(k):
        return beta
    known, speed = np.eye(len(DOMAINS))[k], np.zeros_like(beta)
    for _ in range(steps):
        z = x @ beta.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - ((p - known).T @ x / len(k) + 1e-4 * beta)
        beta = beta + speed
    return beta


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on at most ``sample`` labelled rows, chosen by a hash of the id. Null labels take no part;
    an id labelled more than once counts by its least quality and its most toxic label. Without labels, or without any
    document that has one, posteriors are even."""
    at = F.create_map(*[x for k, (q, t) in enumerate(DOMAINS.values()) for x in (F.lit(f"{q}{t}"), F.lit(k))])
    chosen = (
        labels.where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        .select("doc_id", at[F.concat(F.col("q").cast("string"), F.col("t").cast("string"))].alias("_k"))
    )
    # an id that several documents have counts once for each of them, up to the bound
    matched = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(sample).repartition(8)
    held = stash(spark, _with_words(matched).select("_k", "text", "_w", "_d", "_b", "n_tokens"), "labelled")
    sizes = np.zeros(len(DOMAINS))
    for r in held.df.groupBy("_k").count().collect():
        sizes[r["_k"]] = r["count"]
    counts = np.zeros((BUCKETS, len(DOMAINS)))
    holds = held.df.select("_k", F.explode("_b").alias("b")).groupBy("b").agg(*[F.count_if(F.col("_k") == k).alias(f"d{k}") for k in range(len(DOMAINS))])
    for r in holds.collect():
        counts[r["b"]] = [r[f"d{k}"] for k in range(len(DOMAINS))]
    model = Classifier(_bucket_weights(counts, sizes), np.zeros((len(DOMAINS), len(INPUTS))))
    seen = model.inputs(held.df).select("_k", "_x").collect()
    held.drop()
    model.beta = _regression(np.array([r["_x"] for r in seen], dtype=float), np.array([r["_k"] for r in seen], dtype=int))
    return model


def _replayed(history: list[list[float]], most: float) -> Column:
    """The rate after the steps so far, from ``p``; a step is its length times (e_1 / s_1, ..., pull), and whether a round begins."""
    if not history:
        return F.lit(1.0)
    past = F.split(F.lit(";".join(",".join(map(repr, e)) for e in history)), ";")
    steps = F.transform(past, lambda x: F.split(x, ",").cast("array<double>"))
    dot = lambda e: sum((F.col("p")[k] * e[k] for k in range(len(DOMAINS))), F.lit(0.0))
    pull, begins = len(DOMAINS), len(DOMAINS) + 1

    def moved(s: Column, e: Column) -> Column:
        c = F.when(e[begins] > 0, s["r"]).otherwise(s["c"])
        r = s["r"] - dot(e) - e[pull] * (s["r"] - c)
        return F.struct(F.least(F.lit(most), F.greatest(F.lit(0.0), r)).alias("r"), c.alias("c"))

    return F.aggregate(steps, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("c")), moved)["r"]


def _descend(cells: DataFrame, goal: dict[str, float] | None, factors: dict[str, float] | None, pull: float, most: float, rounds: int) -> list[list[float]]:
    """The steps' history. Targets are shares of all tokens, or multiples of each domain's own share."""
    names = list(DOMAINS)
    own = [float(x or 0) for x in cells.agg(*[F.sum(F.col("n") * F.col("p")[k]) for k in range(len(names))]).first()]
    total = sum(own)
    if not total:
        return []
    share = np.maximum(np.array(own) / total, 1e-9)
    want = share * [factors.get(n, 1.0) for n in names] if factors is not None else np.array([(goal or {}).get(n, 0.0) for n in names])
    scale = np.maximum(share, want)
    history: list[list[float]] = []
    losses: list[float] = []
    left, centre = rounds, 0
    before: tuple[np.ndarray, np.ndarray] | None = None
    length = 0.9
    for _ in range(STEPS):
        rates = cells.withColumn("q", _replayed(history[:-1], most)).withColumn("c", _replayed(history[:centre], most)).withColumn("r", _replayed(history, most))
        got = rates.agg(
            *[F.sum(F.col("n") * F.col("p")[k] * F.col("r")) for k in range(len(names))],
            F.sum(F.col("n") * F.pow(F.col("r") - F.col("q"), 2)), F.sum(F.col("n") * F.pow(F.col("r") - F.col("c"), 2)),
        ).first()
        now, moved, away = np.array(got[: len(names)], dtype=float) / total, got[len(names)] / total, got[len(names) + 1] / total
        if len(history) > centre and moved <= (TOLERANCE * min(1.0, length)) ** 2:
            left -= 1
            if not left:
                return history
            # the next round is pulled towards the rates as they are now, where only the targets' own slope is left
            centre, before, length, losses, away = len(history), None, 0.9, [], 0.0
        error = (now - want) / scale
        losses.append(float(((now - want) ** 2 / scale).sum() / 2 + pull / 2 * away))
        length = 0.9
        if before is not None:
            curve = float((error - before[0]) @ (now - before[1])) + pull * moved
            length = min(max(moved / curve, 0.3), 1 / pull) if curve > 0 else 1 / pull
            if losses[-1] > max(losses[-9:-1]):
                length = 0.9
        before = error, now
        history.append([*(float(length * x) for x in (*error, pull)), float(len(history) == centre)])
    raise RuntimeError(f"rates have not settled in {STEPS} steps")


def mix(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, *, weights: dict[str, float] | None = None, factors: dict[str, float] | None = None,
    sample: int = SAMPLE, seed: int = 5, pull: float = PULL, most: float = 1e9, rounds: int = ROUNDS,
) -> DataFrame:
    """``docs`` with n_tokens, posterior, rate and copies for every row.

    Targets are either ``weights`` (shares of all tokens, one for each domain, summing to 1) or ``factors``
    (multiples of each domain's expected total). No rate is above ``most``. Null and empty texts have no tokens, and rate by their
    posterior like any other. Null and repeated ids are kept; rows that agree in id and text round alike.
    An empty table gives an empty result. Columns named n_tokens, posterior, rate or copies are replaced, others
    may have any names.
    """
    small_batches(spark)
    ours = ("n_tokens", "posterior", "rate", "copies")
    docs = settled(spark, docs.drop(*[c for c in docs.columns if c.lower() in ours]))
    model = learn(spark, docs, labels, sample)
    rid = fresh(docs.columns, "rid")
    rows = docs.withColumn(rid, F.monotonically_increasing_id())
    chance = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("double")
    # one pass over the texts; what follows reads a few bytes a document
    seen = model.inputs(_with_words(rows.select(F.col(rid).alias("_rid"), "text", chance.alias("_u"))))
    known = stash(spark, seen.select("_rid", "_u", "n_tokens", F.array(*model.posterior()).alias("p")), "posteriors")
    rounded = [F.floor(F.col("p")[k] * GRID + 0.5) for k in range(len(DOMAINS))]
    placed = known.df.withColumn("cell", sum((c * (GRID + 1) ** k for k, c in enumerate(rounded)), F.lit(0)).cast("long"))
    tokens = [F.sum(F.col("n_tokens") * F.col("p")[k]) / F.nullif(F.sum("n_tokens"), F.lit(0)) for k in range(len(DOMAINS))]
    grouped = placed.groupBy("cell").agg(
        F.sum("n_tokens").alias("n"), F.array(*[F.coalesce(x, F.avg(F.col("p")[k])) for k, x in enumerate(tokens)]).alias("p")
    )
    cells = stash(spark, grouped.coalesce(2), "cells")
    history = _descend(cells.df, weights, factors, pull, most, rounds)
    rates = stash(spark, cells.df.select("cell", _replayed(history, most).alias("rate")).coalesce(1), "rates")
    cells.drop()
    rated = placed.join(F.broadcast(rates.df), "cell").select(
        F.col("_rid").alias(rid), "n_tokens", F.col("p").alias("posterior"), "rate", F.floor(F.col("rate") + F.col("_u")).cast("int").alias("copies")
    )
    return rows.join(rated, rid).drop(rid)
