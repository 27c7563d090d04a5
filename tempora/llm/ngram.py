"""Exact Jaccard join of documents on word n-grams, as a blocked product of the incidence matrix.

The document by n-gram incidence matrix times its transpose holds all overlaps. Only those entries are
formed that size-derived bounds leave open:

* Documents with one n-gram set are one class, so copies are one row of the matrix.
* Rows keep a prefix of n - ceil(t n) + 1 columns in one order of all n-grams; two sets with similarity
  t share a column there. The order puts n-grams that many documents hold last (counted over all
  documents; which of them are listed only changes the order, never the result).
* Column by column, entries are bounded by sizes, by the places of the shared column in both rows, and
  by how much two sketches differ (parities of 256 buckets in every column, then those of twice as many buckets as
  n-grams once for each pair), which never exceeds the sets' own difference.
* What is left is multiplied out on whole sets, and overlaps are counted exactly.

A column that m rows share is not squared. First its most central row meets the others (m - 1 entries).
Rows that are linked by then need no further entry between them. For columns whose rows still lie in
several components, blocks of 1,024 by 1,024 rows are bounded in memory, and of the pairs that pass
a block gives a spanning forest over components. A column all of whose open pairs were given is done. One that
kept pairs back comes again, and the last round gives every pair left. So no link between different sets is lost, and
pairs are given one and all only where forests joined nothing more.

That gives components, not every link. Links lie within components, so each set's links are counted over the
blocks of its component's own product, on whole sets; a block emits one number for each row, no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import bytesx
from tempora.llm.components import components
from tempora.llm.occurrences import numbered, with_text
from tempora.llm.scratch import Stash, stash

WORDS = 3
PERCENT = 90
#: N-grams listed as frequent, at most, and the documents of one task that make one a candidate.
LISTED, FREQUENT = 65_536, 16
BLOCK = 1_024
#: N-grams of one block where links are counted, and entries of the dense stripes it is multiplied out by.
BLOCK_GRAMS, STRIPE = 1_000_000, 4_000_000
FOREST_ROUNDS = 3
_COUNTERS = 1 << 22
#: Open pairs that a task holds before it thins them out or gives them.
HELD = 200_000


def _sketch(g: np.ndarray) -> np.ndarray:
    """Parities of how many n-grams lie in each of 512 buckets or, if that is more, some twice to four times their number."""
    buckets = 1 << max(9, int(2 * len(g)).bit_length())
    odd = np.bincount((g & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets).astype(np.uint8) & 1
    return np.packbits(odd).view(np.uint64)


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch over fewer buckets: those whose numbers agree in their low bits are one."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _apart(x: bytes, y: bytes) -> int:
    """At most the difference of the sets."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    words = min(len(a), len(b))
    return int(np.bitwise_count(_folded(a, words) ^ _folded(b, words)).sum(dtype=np.int64))


def grams(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram digests of each document; A-Z count as a-z.

    With fewer than ``words`` words the whole sequence is one n-gram; without words there is none.
    """
    small = bytesx.lower(data)
    starts, ends, counts = bytesx.words(small, offsets)
    named = bytesx.Runs(small)(starts, ends)
    every = bytesx.chained(named, np.arange(max(0, len(starts) - words + 1)), words)
    begin = np.concatenate(([0], np.cumsum(counts)))
    for i, n in zip(begin[:-1].tolist(), counts.tolist(), strict=True):
        if n >= words:
            yield np.unique(every[i : i + n - words + 1])
        elif n:
            yield bytesx.chained(named, np.array([i]), n)
        else:
            yield np.zeros(0, np.uint64)


def frequent(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams in ascending order, their place by count): at most LISTED of those that many documents hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(_COUNTERS, np.uint32)
        known, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            for _, _, data, offsets in bytesx.slices(b["text"]):
                found, n = np.unique(np.concatenate([*grams(data, offsets, words)]), return_counts=True)
                if not len(found):
                    continue
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    old = known[at] == found
                    times[at[old]] += n[old]
                    found, n = found[~old], n[~old]
                slot = (found & np.uint64(_COUNTERS - 1)).astype(np.int64)
                np.add.at(counters, slot, n.astype(np.uint32))
                new = counters[slot] >= FREQUENT
                if new.any():
                    known, times = np.concatenate((known, found[new])), np.concatenate((times, counters[slot[new]].astype(np.int64)))
                    by = np.argsort(known)
                    known, times = known[by], times[by]
        often = times >= FREQUENT
        yield pa.RecordBatch.from_arrays([bytesx.longs(known[often]), pa.array(times[often])], names=["gram", "times"])

    counted = rows.select("text").mapInArrow(count, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))
    top = counted.orderBy(F.desc("times"), "gram").limit(LISTED).toArrow()
    gram, times = top["gram"].to_numpy().view(np.uint64), top["times"].to_numpy()
    place = np.empty(len(gram), np.int64)
    place[np.lexsort((gram, times))] = np.arange(1, len(gram) + 1)
    by = np.argsort(gram)
    return gram[by], place[by]


#: Parities of 256 buckets.
PARITY = ("s1", "s2", "s3", "s4")
ROW = "rid long, doc_id long, n int, k1 long, k2 long, prefix array<long>, sketch binary, " + ", ".join(f"{s} long" for s in PARITY)


def incidence(spark: SparkSession, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """One matrix row for each document: size, set digest, ordered prefix and parity sketch."""
    listed = spark.sparkContext.broadcast(frequent(rows, words))  # LISTED entries at most: one MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, place = listed.value
        for b in batches:
            rid, ids = b["rid"], b["doc_id"]
            for i, j, data, offsets in bytesx.slices(b["text"]):
                sizes, keys, prefix, sketch = [], [], [], []
                for g in grams(data, offsets, words):
                    n = len(g)
                    sizes.append(n)
                    keys.append((int(np.add.reduce(bytesx.mix(g))), int(np.add.reduce(bytesx.mix(g ^ bytesx.M1)))))
                    sketch.append(_sketch(g))
                    p = n - -(-percent * n // 100) + 1 if n else 0
                    if len(often) and n:
                        at = np.minimum(np.searchsorted(often, g), len(often) - 1)
                        rank = np.where(often[at] == g, place[at], 0)
                        if rank.any():
                            g = g[np.lexsort((g, rank))]
                    prefix.append(g[:p])
                k = np.array(keys, dtype=np.uint64).reshape(-1, 2)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in prefix]))).astype(np.int32)
                parity = np.stack([_folded(x, len(PARITY)) for x in sketch]).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    rid[i:j], ids[i:j], pa.array(np.array(sizes, np.int32)), bytesx.longs(k[:, 0]), bytesx.longs(k[:, 1]),
                    pa.ListArray.from_arrays(pa.array(ends), bytesx.longs(np.concatenate(prefix))),
                    pa.array([x.tobytes() for x in sketch], pa.binary()), *(pa.array(x) for x in parity.T.copy()),
                ], names=["rid", "doc_id", "n", "k1", "k2", "prefix", "sketch", *PARITY])

    return rows.mapInArrow(run, ROW)


def _least_overlap(n: Column, m: Column, percent: int) -> Column:
    """The least overlap of sets of n and m members with that similarity: o >= p (n + m) / (100 + p)."""
    return F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def _verified(spark: SparkSession, rows: DataFrame, pairs: DataFrame, words: int, percent: int) -> Stash:
    """Of ``pairs`` (a, b) of rows those that link, by the whole sets' overlap."""
    asked = stash(spark, pairs, "pairs")
    wanted = asked.df.select(F.col("a").alias("rid")).union(asked.df.select("b")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in bytesx.slices(b["text"]):
                found = [g.tobytes() for g in grams(data, offsets, words)]
                yield pa.RecordBatch.from_arrays([b["rid"][i:j], pa.array(found, pa.binary())], names=["rid", "members"])

    whole = stash(spark, with_text(rows, wanted).mapInArrow(sets, "rid long, members binary"), "sets")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            link = []
            for x, y in zip(b["x"], b["y"], strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), max(len(x) - 1, 0))
                both = int((x[at] == y).sum()) if len(x) and len(y) else 0
                link.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(link, pa.bool_()))

    met = asked.df.join(whole.df.select(F.col("rid").alias("a"), F.col("members").alias("x")), "a").join(
        whole.df.select(F.col("rid").alias("b"), F.col("members").alias("y")), "b"
    )
    out = stash(spark, met.select("a", "b", "x", "y").mapInArrow(multiply, "a long, b long"), "links")
    for t in (asked, whole):
        t.drop()
    return out


def _open_pairs(t: pa.Table, percent: int, forest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs within whole (column, block, block) groups, in different components, that the bounds leave open.

    With ``forest`` one of each pair of components, as few as join them; ``gram`` then names, in rows without a pair,
    the columns of which pairs were kept back.

    Row i meets row i + d of its group for d = 1, 2, ...: all groups at once, each as long as it has such rows.
    """
    gram, p, q, rid, n, pos, root, side = (t[k].to_numpy() for k in ("gram", "p", "q", "rid", "n", "pos", "root", "side"))
    sketch = np.column_stack([t[s].to_numpy() for s in PARITY]).view(np.uint64)
    _, tree = np.unique(root, return_inverse=True)
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    at = np.flatnonzero(new)
    end = np.repeat(np.concatenate((at[1:], [len(gram)])), np.diff(np.concatenate((at, [len(gram)]))))
    row = np.arange(len(gram))
    found: list[np.ndarray] = []
    backward: list[np.ndarray] = []

    def thinned() -> np.ndarray:
        """One pair of each two components; columns of the others are noted."""
        pair = np.concatenate(found)
        two = np.sort(tree[pair[:, :2]], axis=1)
        _, first = np.unique(two[:, 0] * len(gram) + two[:, 1], return_index=True)
        back = np.ones(len(pair), dtype=bool)
        back[first] = False
        backward.append(np.unique(gram[pair[back, 0]]))
        return pair[first]

    def given(pair: np.ndarray, grams: np.ndarray) -> pa.RecordBatch:
        a, b, none = rid[pair[:, 0]], rid[pair[:, 1]], pa.nulls(len(grams), pa.int64())
        cells = (pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(pair[:, 2]))
        return pa.RecordBatch.from_arrays([*(pa.concat_arrays([x, none]) for x in cells), pa.concat_arrays([pa.nulls(len(pair), pa.int64()), pa.array(grams)])], names=["a", "b", "most", "gram"])

    nothing = np.zeros(0, np.int64)
    d = held = 1
    while len(row := row[row + d < end[row]]):
        for k in range(0, len(row), HELD):
            i = row[k : k + HELD]
            j = i + d
            total = n[i].astype(np.int64) + n[j]
            least = -(-percent * total // (100 + percent))
            ok = (root[i] != root[j]) & ((side[i] == 2) | (side[i] != side[j])) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least)
            i, j, most = i[ok], j[ok], (total - 2 * least)[ok]
            if len(i):
                ok = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= most
                found.append(np.column_stack((i[ok], j[ok], most[ok])))
                held += int(ok.sum())
            if held > HELD:
                if forest:
                    found = [thinned()]
                else:
                    yield given(np.concatenate(found), nothing)
                    found = []
                held = sum(map(len, found))
        d += 1
    pair = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    if forest and len(pair):
        pair = thinned()
        parent: dict[int, int] = {}

        def find(v: int) -> int:
            while parent.get(v, v) != v:
                parent[v] = parent.get(parent[v], parent[v])
                v = parent[v]
            return v

        keep = np.zeros(len(pair), dtype=bool)
        for k, (u, v) in enumerate(tree[pair[:, :2]].tolist()):
            u, v = find(u), find(v)
            if u != v:
                parent[u] = v
                keep[k] = True
        backward.append(gram[pair[~keep, 0]])
        pair = pair[keep]
    yield given(pair, np.unique(np.concatenate(backward)) if backward else nothing)


def _linked(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(rid, number of links to rows of the other side) within one (component, block, block) group."""
    rid, side = t["rid"].to_numpy(), t["side"].to_numpy()
    _, _, data, offsets = next(bytesx.slices(t["members"].combine_chunks(), 1 << 40))
    size = np.diff(offsets) // 8
    _, col, times = np.unique(data.view(np.uint64), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(size)), size), times[col] > 1
    col, row = (np.cumsum(times > 1) - 1)[col[shared]], row[shared]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    both = np.zeros((len(left), len(right)), np.int64)
    width = max(1, STRIPE // len(size))
    for c in range(0, int((times > 1).sum()), width):
        i, j = np.searchsorted(col, [c, c + width])
        stripe = np.zeros((len(size), min(width, int(col[j - 1]) - c + 1)), np.float32)
        stripe[row[i:j], col[i:j] - c] = 1
        both += (stripe[left] @ stripe[right].T).astype(np.int64)
    link = (both > 0) & (100 * both >= percent * (size[left][:, None] + size[right] - both))
    link &= rid[left][:, None] != rid[right]
    links = np.zeros(len(size), np.int64)
    links[left] = link.sum(axis=1)
    if side[0] != 2:
        links[right] = link.sum(axis=0)
    return rid, links


def _degrees(spark: SparkSession, rows: DataFrame, sizes: DataFrame, roots: DataFrame, words: int, percent: int) -> Stash:
    """(rid, links): the number of other rows that each row of a component links to."""
    within = roots.select(F.col("node").alias("rid"), "root").join(sizes, "rid")
    of = within.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("size"))
    placed = within.join(
        of.select("root", "rows", F.ceil(F.greatest(F.col("rows") / F.lit(BLOCK), F.col("size") / F.lit(BLOCK_GRAMS))).cast("int").alias("blocks")), "root"
    )
    held = stash(spark, placed.select("rid", "root", "rows", "blocks"), "members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in bytesx.slices(b["text"]):
                found = [g.tobytes() for g in grams(data, offsets, words)]
                yield pa.RecordBatch.from_arrays([*(b[k][i:j] for k in ("rid", "root", "blocks")), pa.array(found, pa.binary())], names=["rid", "root", "blocks", "members"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups from a stream sorted by them."""
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.column_stack([b[k].to_numpy() for k in ("root", "p", "q")])
            at = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            out = []
            for i, j in zip(at[:-1], at[1:], strict=True):
                now = tuple(key[i].tolist())
                if held and now != last:
                    out.append(_linked(pa.Table.from_batches(held), percent))
                    held = []
                held.append(b.slice(i, j - i))
                last = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["rid", "links"])
        if held:
            rid, links = _linked(pa.Table.from_batches(held), percent)
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(links)], names=["rid", "links"])

    # Two rows alone in a component are one link; where there are more, each row goes to every pair of blocks that holds its own.
    whole = with_text(rows, held.df.where("rows > 2").select("rid", "root", "blocks")).select("rid", "root", "blocks", "text")
    whole = whole.mapInArrow(sets, "rid long, root long, blocks int, members binary")
    own = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    dealt = whole.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "rid",
        F.when(F.col("own") == F.col("other"), F.lit(2)).when(F.col("own") < F.col("other"), F.lit(0)).otherwise(F.lit(1)).alias("side"), "members",
    )
    part = dealt.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").mapInArrow(count, "rid long, links long")
    pairs = held.df.where("rows = 2").select("rid", F.lit(1).cast("long").alias("links"))
    out = stash(spark, part.union(pairs).groupBy("rid").agg(F.sum("links").alias("links")), "degrees")
    held.drop()
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT, count_links: bool = True) -> DataFrame:
    """(rid, doc_id, n_shingles[, n_links], component_id, group_id) for every row; ``rid`` is its place in the input.

    Two rows link when 100 * overlap >= percent * union of their n-gram sets. component_id is the least
    doc_id reachable, the row's own included; n_links counts all different sets that link to the row's
    own (copies of one set count once). Rows without words link
    with nothing. group_id tells components apart where ids are null or repeated (null without words). Null
    ids are left out of the least (null if a component has no other). Repeated rows are one class. An empty
    table gives an empty result.
    """
    rows = numbered(docs)
    table = stash(spark, incidence(spark, rows, words, percent), "incidence")
    everything = table.df
    classes = stash(
        spark, everything.where("n > 0").groupBy("k1", "k2").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least")), "classes"
    )
    rep = everything.join(classes.df.select("rid"), "rid", "left_semi")
    entries = rep.select("rid", F.posexplode("prefix").alias("pos", "gram"))
    shared = entries.groupBy("gram").agg(F.count("*").alias("rows")).where("rows > 1").select("gram")
    # sizes and parities come after the columns that no other row shares have gone
    columns = stash(spark, entries.join(shared, "gram", "left_semi").join(rep.select("rid", "n", *PARITY), "rid"), "columns")
    sketches = everything.select("rid", "sketch")

    # The row in which a shared column comes first holds fewest n-grams of its own: the most central one.
    centre = columns.df.groupBy("gram").agg(F.min(F.struct("pos", "rid", "n", *PARITY)).alias("c"))
    met = columns.df.join(centre, "gram").where("rid <> c.rid")
    least = _least_overlap(F.col("n"), F.col("c.n"), percent)
    bounded = met.where(F.least(F.col("n") - F.col("pos"), F.col("c.n") - F.col("c.pos")) >= least)
    most = (F.col("n") + F.col("c.n") - 2 * least).cast("long")
    apart = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"c.{s}"))) for s in PARITY), F.lit(0))
    central = bounded.where(apart <= most).select(F.least("rid", "c.rid").alias("a"), F.greatest("rid", "c.rid").alias("b"), most.alias("most")).distinct()

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [_apart(x.as_py(), y.as_py()) <= most for x, y, most in zip(b["x"], b["y"], b["most"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    def linked(pairs: DataFrame) -> Stash:
        """Of ``pairs`` (a, b, most) those that link: by the whole sketches, then by the whole sets."""
        met = pairs.join(sketches.select(F.col("rid").alias("a"), F.col("sketch").alias("x")), "a").join(
            sketches.select(F.col("rid").alias("b"), F.col("sketch").alias("y")), "b"
        )
        return _verified(spark, rows, met.select("a", "b", "most", "x", "y").mapInArrow(close, "a long, b long"), words, percent)

    links = linked(central)
    roots = components(spark, links.df)
    links.drop()
    todo, forest = columns, True
    for turn in range(FOREST_ROUNDS + 1):
        forest = forest and turn < FOREST_ROUNDS
        offers = stash(spark, _between(todo.df, roots.df, percent, forest), "offers")
        links = linked(offers.df.where("a is not null").select("a", "b", "most").distinct())
        left = offers.df.where("a is null").select("gram").distinct()
        # where a forest joined nothing, the pairs it kept back are asked one and all
        forest = forest and not links.df.isEmpty()
        if not links.df.isEmpty():
            more = components(spark, links.df.union(roots.df.select(F.col("node").alias("a"), F.col("root").alias("b"))))
            roots.drop()
            roots = more
        over = left.isEmpty()
        if not over:
            rest = stash(spark, todo.df.join(left, "gram", "left_semi"), "columns")
            todo.drop()
            todo = rest
        for t in (offers, links):
            t.drop()
        if over:
            break
    todo.drop()
    counted = [_degrees(spark, rows, everything.select("rid", "n"), roots.df, words, percent)] if count_links else []
    joined = classes.df.join(roots.df.withColumnRenamed("node", "rid"), "rid", "left")
    joined = joined.join(counted[0].df, "rid", "left") if counted else joined.withColumn("links", F.lit(None).cast("long"))
    joined = joined.withColumn("root", F.coalesce("root", "rid"))
    low = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stash(spark, joined.join(low, "root").select("k1", "k2", F.coalesce("links", F.lit(0)).alias("n_links"), "component_id", F.col("root").alias("group_id")), "components")
    result = stash(spark, everything.select("rid", "doc_id", "n", "k1", "k2").join(named.df, ["k1", "k2"], "left").select(
        "rid", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "group_id",
    ), "result")
    for t in (table, classes, named, roots, *counted):
        t.drop()
    return result.df if counted else result.df.drop("n_links")


def _between(columns: DataFrame, roots: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs of rows that share a column, lie in different components, and pass the bounds (see ``_open_pairs``)."""
    placed = columns.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    split = placed.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows")).where("low <> high")
    members = placed.join(split.select("gram", "rows"), "gram")
    blocks = F.ceil(F.col("rows") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("rid"), blocks).cast("int")
    # Each row goes to every pair of blocks that holds its own; within its own block it is on both sides.
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "gram", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "rid", "n", "pos", "root", *PARITY,
        F.when(F.col("own") == F.col("other"), F.lit(2)).when(F.col("own") < F.col("other"), F.lit(0)).otherwise(F.lit(1)).alias("side"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups from a stream sorted by them; a group has 2 * BLOCK rows or so."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = np.column_stack([b[k].to_numpy() for k in ("gram", "p", "q")])
            at = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0
            same = not held or tuple(held[-1][k][held[-1].num_rows - 1].as_py() for k in ("gram", "p", "q")) == tuple(key[0].tolist())
            if held and not same:
                yield from _open_pairs(pa.Table.from_batches(held), percent, forest)
                held = []
            if at:
                held.append(b.slice(0, at))
                yield from _open_pairs(pa.Table.from_batches(held), percent, forest)
                held = []
            held.append(b.slice(at))
        if held:
            yield from _open_pairs(pa.Table.from_batches(held), percent, forest)

    return dealt.repartition("gram", "p", "q").sortWithinPartitions("gram", "p", "q").mapInArrow(run, "a long, b long, most long, gram long")
