"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: the mean and an orthogonal rotation are learned (iterative quantisation: alternate between
signs of the rotated vectors and the rotation that best maps vectors to those signs) on a bounded
sample; the code of a vector is the sign pattern of its rotated form. Codes are cut into
m substrings of 16 bits, and each has a table (substring, value) -> rows. By the pigeonhole principle,
a code within Hamming radius r of the query's agrees with it up to floor(r / m) bits in one of
them at least (one bit less in the substrings after the first r mod m + 1), so looking up every value
within that distance retrieves every code within r.

Tables and queries meet by an equi-join on (substring, block of values, part). A block has the values with
the same high bits; a query is sent only to blocks whose high bits are near enough, and within one it looks up
the values it probes, nothing else. Parts split a block that has very many rows. Of what probes
retrieve, codes within r are kept, each from the first substring that finds it, and reranked by the
exact inner product of the original vectors. Queries that find fewer than k rows are asked again with a
wider radius, up to all bits, which retrieves every row.

Codes are longer than vectors are wide (256 bits), as the spread of Hamming distances at one angle falls
with the root of their length: a radius that holds the neighbours holds few other rows to rerank.

Equal vectors are nearest in the order of their ids, so k + 1 of them stand for all.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm import bytesx
from tempora.llm.scratch import Stash, small_batches, stash

SAMPLE = 20_000
#: Points of the sample whose true neighbours among all rows set the radius.
PROBES = 256
ROUNDS = 30
#: Bits of a code, of a substring, and of a word that holds four of these.
BITS, WIDTH, WORD = 256, 16, 64
#: Rows of one part of a block of one table, or so.
PART_ROWS = 16_384
#: Queries that are probed at once.
TOGETHER = 32


def sound(vector: Column) -> Column:
    """Not null, not zero, and all components finite numbers."""
    v = vector.cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(ok & F.exists(v, lambda x: x != 0), F.lit(False))


def learn_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and a (dim, bits) matrix with orthonormal columns (rows where bits exceed dim).

    A sample of fewer rows than dimensions, or none, still gives a usable random rotation.
    """
    dim = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
    rng = np.random.default_rng(seed)
    lift = np.linalg.qr(rng.standard_normal((max(bits, dim), max(bits, dim))))[0][:dim, :bits]
    if len(sample) <= dim or bits < dim:
        return mean, lift
    x = (sample - mean) @ lift
    turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        codes = np.where(x @ turn > 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(codes.T @ x)
        turn = (u @ v).T
    return mean, lift @ turn


def encode(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Codes as rows of packed bytes."""
    return np.packbits((vectors - mean) @ turn > 0, axis=1)


def masks(width: int, radius: int) -> list[int]:
    """All words of ``width`` bits with ``radius`` bits set at most."""
    return [sum(1 << b for b in c) for r in range(min(radius, width) + 1) for c in itertools.combinations(range(width), r)]


def radii(radius: int, m: int) -> list[int]:
    """How far to probe each of m substrings; -1: not at all."""
    whole, extra = divmod(radius, m)
    return [whole if s <= extra else whole - 1 for s in range(m)]


def _packed(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().cast(pa.float64())).reshape(-1, dim)


class Table:
    """One part of one block of one substring's table: values to rows."""

    def __init__(self, s: int, block: int, high: int, ids: np.ndarray, codes: np.ndarray, reach: int, m: int):
        self.s, self.block, self.low_bits, self.reach, self.near = s, block, WIDTH - high, reach, radii(reach, m)
        value = self._sub(codes, s)
        order = np.argsort(value, kind="stable")
        self.ids, self.codes = ids[order], codes[order]
        self.at = np.searchsorted(value[order], np.arange((block << self.low_bits), ((block + 1) << self.low_bits) + 1))
        self.probes = {r: np.array(masks(self.low_bits, r)) for r in range(self.near[s] + 1)}

    @staticmethod
    def _sub(codes: np.ndarray, s: int) -> np.ndarray:
        w, place = divmod(WIDTH * s, WORD)
        return ((codes[:, w] >> np.uint64(place)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)

    def __call__(self, q_ids: np.ndarray, q_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query id, row id) of codes within reach that no earlier substring retrieves."""
        out = []
        value = self._sub(q_codes, self.s)
        left = self.near[self.s] - np.bitwise_count((value >> self.low_bits) ^ self.block).astype(np.int64)
        for r in np.unique(left[left >= 0]).tolist():
            mine = np.flatnonzero(left == r)
            for i in range(0, len(mine), TOGETHER):
                q = mine[i : i + TOGETHER]
                probe = (value[q] & ((1 << self.low_bits) - 1))[:, None] ^ self.probes[r][None, :]
                count = self.at[probe + 1] - self.at[probe]
                who, which = np.nonzero(count)
                size = count[who, which]
                row, who = bytesx.ragged(self.at[probe[who, which]], size), np.repeat(q[who], size)
                away = np.bitwise_count(q_codes[who, 0] ^ self.codes[row, 0]).astype(np.int16)
                for w in range(1, q_codes.shape[1]):
                    away += np.bitwise_count(q_codes[who, w] ^ self.codes[row, w])
                near = np.flatnonzero(away <= self.reach)
                who, row = who[near], row[near]
                apart, ok = q_codes[who] ^ self.codes[row], q_ids[who] != self.ids[row]
                for s in range(self.s):
                    ok &= np.bitwise_count(self._sub(apart, s)).astype(np.int64) > self.near[s]
                out.append((q_ids[who[ok]], self.ids[row[ok]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def words(bits: int) -> list[str]:
    """The columns of a code: its 64-bit words."""
    return [f"c{w}" for w in range(-(-bits // WORD))]


def _sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces with one key of a stream sorted by it."""
    for b in batches:
        if b.num_rows:
            k = np.column_stack([b[x].to_numpy() for x in keys])
            at = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
            for i, j in itertools.pairwise(at):
                yield tuple(k[i].tolist()), b.slice(i, j - i)


def retrieved(index: DataFrame, asked: DataFrame, reach: int, bits: int, high: int) -> DataFrame:
    """(query_id, vec_id) of all codes within ``reach`` of each query's code. Both tables have an id and the code's words (see ``words``)."""
    m = bits // WIDTH
    near = radii(reach, m)
    code = words(bits)
    value = lambda s: F.shiftrightunsigned(code[WIDTH * s // WORD], WIDTH * s % WORD).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")
    block = lambda s: F.shiftright(value(s), WIDTH - high)
    spread = F.array(*[F.struct(F.lit(s).alias("s"), block(s).alias("block")) for s in range(m) if near[s] >= 0])
    rows = index.select("id", *code, F.explode(spread).alias("t")).select("id", *code, "t.*")
    parts = rows.groupBy("s", "block").agg(F.ceil(F.count("*") / F.lit(PART_ROWS)).cast("int").alias("parts"))  # m << high rows at most
    placed = rows.join(F.broadcast(parts), ["s", "block"]).select("s", "block", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(0).alias("kind"), "id", *code)
    turns = [F.transform(F.array(*[F.lit(x) for x in masks(high, near[s])]), _turned(block(s), s)) for s in range(m) if near[s] >= 0]
    probes = asked.select("id", *code, F.explode(F.flatten(F.array(*turns))).alias("t")).select("id", *code, "t.*").join(F.broadcast(parts), ["s", "block"])
    sent = probes.select("s", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "id", *code)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, table = None, [], None
        for key, b in _sorted_runs(batches, ["s", "block", "part", "kind"]):
            if key[:3] != last:
                last, held, table = key[:3], [], None
            ids, codes = b["id"].to_numpy(), np.column_stack([b[c].to_numpy() for c in code]).view(np.uint64)
            if key[3] == 0:
                held.append((ids, codes))
                continue
            if table is None and held:
                table = Table(key[0], key[1], high, *(np.concatenate(x) for x in zip(*held, strict=True)), reach, m)
            if table is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in table(ids, codes)], names=["query_id", "vec_id"])

    keys = ["s", "block", "part"]
    return placed.unionByName(sent).repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(look_up, "query_id long, vec_id long")


def _turned(block: Column, s: int):
    return lambda x: F.struct(F.lit(s).alias("s"), block.bitwiseXOR(x).alias("block"))


def _reranked(spark: SparkSession, pairs: DataFrame, vectors: DataFrame, asked: DataFrame, k: int, dim: int) -> Stash:
    """(query_id, vec_id, score): the k best of each query's pairs by the exact inner product."""
    met = pairs.join(vectors.withColumnRenamed("id", "vec_id"), "vec_id").select("query_id", F.lit(1).alias("kind"), "vec_id", "v")
    own = asked.select(F.col("id").alias("query_id"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("vec_id"), "v")

    def best_of(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        last, vector, ids, scores = None, None, np.zeros(0, np.int64), np.zeros(0)

        def given() -> pa.RecordBatch:
            sizes = [len(x[1]) for x in out]
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat([x[0] for x in out], sizes).astype(np.int64)), pa.array(np.concatenate([x[1] for x in out])), pa.array(np.concatenate([x[2] for x in out]))
            ], names=["query_id", "vec_id", "score"])

        for (query, kind), b in _sorted_runs(batches, ["query_id", "kind"]):
            if query != last:
                if last is not None and len(ids):
                    out.append((last, ids, scores))
                last, vector, ids, scores = query, None, np.zeros(0, np.int64), np.zeros(0)
                if len(out) >= 256:
                    yield given()
                    out = []
            points = _packed(b["v"], dim)
            if kind == 0:
                vector = points if vector is None else np.concatenate((vector, points))
            else:
                # an id that several queries' vectors have is one query: its best by any of them
                fresh = np.max([(points * one).sum(axis=1) for one in vector], axis=0)
                ids, scores = best_of(np.concatenate((ids, b["vec_id"].to_numpy())), np.concatenate((scores, fresh)))
        if last is not None and len(ids):
            out.append((last, ids, scores))
        if out:
            yield given()

    each = met.unionByName(own).repartition("query_id").sortWithinPartitions("query_id", "kind")
    return stash(spark, each.mapInArrow(run, "query_id long, vec_id long, score double"), "best")


def calibrated_radius(index: DataFrame, ids: np.ndarray, points: np.ndarray, mean: np.ndarray, turn: np.ndarray, k: int, share: float = 0.95) -> int:
    """The Hamming radius that holds ``share`` of the k true neighbours that the given points have among all rows of the index.

    Neighbours come nearer as a table grows, so a radius from a part of it would retrieve a share of all pairs that
    never falls. One pass compares the points (a fixed number) with every row; each task keeps k for each.
    """
    bits = turn.shape[1]
    if len(points) < 1:
        return bits
    names, dim = words(bits), points.shape[1]
    wide = np.zeros((len(points), len(names) * 8), np.uint8)
    wide[:, : bits // 8] = encode(points, mean, turn)
    codes = wide.view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, apart = np.full((len(points), k), -np.inf), np.zeros((len(points), k), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            scores = points @ _packed(b["v"], dim).T
            scores[ids[:, None] == b["id"].to_numpy()[None, :]] = -np.inf
            code = np.column_stack([b[c].to_numpy() for c in names]).view(np.uint64)
            away = np.bitwise_count(codes[:, None, :] ^ code[None, :, :]).sum(axis=2, dtype=np.int64)
            best, apart = np.concatenate((best, scores), axis=1), np.concatenate((apart, away), axis=1)
            top = np.argpartition(-best, k - 1, axis=1)[:, :k]
            best, apart = np.take_along_axis(best, top, 1), np.take_along_axis(apart, top, 1)
        probe, at = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(best[probe, at]), pa.array(apart[probe, at])], names=["probe", "score", "away"])

    first = Window.partitionBy("probe").orderBy(F.desc("score"), "away")
    near = index.select("id", "v", *names).mapInArrow(run, "probe long, score double, away long").withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= k)
    away = near.select("away").toArrow()["away"].to_numpy()  # PROBES * k numbers at most
    return int(np.ceil(np.quantile(away, share))) if len(away) else bits


def nearest(
    spark: SparkSession, base: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding",
    sample: int = SAMPLE, bits: int = BITS, radius: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query.

    Vectors that are null, zero, or hold null or non-finite components take no part, and neither do
    null ids or vectors of another length than most. A query never meets rows of its own id. Rows
    repeated with one id and vector count once. Ties go to the smaller id. Empty tables give none.
    The rotation is fitted on at most ``sample`` rows, the radius on the neighbours of ``PROBES`` of them among all; every row is indexed. ``bits`` is a
    multiple of 16.
    """
    small_batches(spark)

    def tidy(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        return df.where(F.col(id_col).isNotNull() & sound(v)).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))

    def known(df: DataFrame, name: str) -> Stash:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                wide = np.zeros((b.num_rows, len(words(bits)) * 8), np.uint8)
                if b.num_rows:
                    wide[:, : bits // 8] = encode(_packed(b["v"], dim), mean, turn)
                code = wide.view(np.int64).T
                yield pa.RecordBatch.from_arrays([b["id"], b["v"], *(pa.array(np.ascontiguousarray(x)) for x in code)], names=["id", "v", *words(bits)])

        return stash(spark, df.mapInArrow(run, "id long, v array<double>, " + ", ".join(f"{w} long" for w in words(bits))), name)

    rows, asked = tidy(base), tidy(queries).dropDuplicates(["id", "v"])
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").take(1)
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    fit = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").toArrow()
    points, ids = _packed(fit["v"], dim), fit["id"].to_numpy()
    mean, turn = learn_rotation(points, bits)
    alike = Window.partitionBy("v").orderBy("id")
    rows = rows.withColumn("_k", F.dense_rank().over(alike)).where(F.col("_k") <= k + 1).drop("_k").dropDuplicates(["id", "v"])
    index, todo = known(rows, "index"), known(asked, "asked")
    reach = calibrated_radius(index.df, ids[:PROBES], points[:PROBES], mean, turn, k) if radius is None else radius
    high = min(WIDTH, max(0, int(np.ceil(np.log2(max(1, n / PART_ROWS))))))
    found: list[DataFrame] = []
    while True:
        pairs = stash(spark, retrieved(index.df, todo.df, reach, bits, high), "pairs")
        best = _reranked(spark, pairs.df, index.df.select("id", "v"), todo.df.select("id", "v"), k, dim)
        pairs.drop()
        if reach >= bits:
            found.append(best.df)
            break
        full = best.df.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
        short = stash(spark, todo.df.join(full, todo.df["id"] == full["query_id"], "left_anti"), "asked")
        found.append(best.df.join(full, "query_id", "left_semi"))
        if short.df.isEmpty():
            break
        todo, reach = short, min(bits, reach + bits // 8)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(ranked)).select("query_id", "rank", "vec_id", "score")
