"""Removal of every byte covered by a long string that starts anywhere else, by suffix arrays.

A window is ``length`` consecutive bytes of one document. Each window chooses the leftmost of its
16-byte grams with the least hash; windows with one choice form stretches (see ``occurrences``). All
stretches that share an anchor name are cut out of their documents, copies once with their number, and
go to shards by name. A shard orders all its suffixes (Larsson-Sadakane), measures common prefixes of
neighbours (Kasai), and finds every window that starts twice: neighbours that share ``length`` bytes.

A name with more than HOT different stretches (a passage that very many documents hold, in different
surroundings) is split over several shards. Then each shard's windows of that name that repeat
nowhere within it are merged across shards: sorted runs of digests, cut into ranges, are searched in
one another by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import bytesx, suffixes
from tempora.llm.occurrences import NONE, collapsed, numbered, repeated, with_text
from tempora.llm.scratch import fresh, settled, stash

LENGTH = 200
GRAM = 16
HOT = 1_024
SHARD_BYTES = 1_000_000
RANGE = 200_000


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, first start, number of starts, name, body digest, times in a row) of every stretch of the documents."""
    n = len(data)
    if n < length or length < gram:
        return NONE
    names = bytesx.Runs(data).grams(gram)
    value = (names & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(names), dtype=np.uint64)
    width, have, low = length - gram + 1, 1, value
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(value) - width + 1], low[width - have : width - have + len(value) - width + 1])
    chosen = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    whole = sizes >= length
    starts = bytesx.ragged(offsets[:-1][whole], sizes[whole] - length + 1)
    if not len(starts):
        return NONE
    pick = chosen[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = pick[1:] != pick[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(starts)])))
    s0 = starts[first]
    body = bytesx.Runs(data, salt=0xB0D1)(s0, s0 + count + length - 1)
    doc = np.searchsorted(offsets, s0, side="right") - 1
    return collapsed(doc, s0 - offsets[doc], count, names[pick[first]], body)


def _repeats(regions: list[bytes], counts: np.ndarray, times: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(region, start) of the windows among each region's first ``counts`` starts whose bytes start twice.

    A region that stands for several copies counts as often as its ``times``.
    """
    size = np.array([len(r) for r in regions], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    text = np.zeros(int((size + 1).sum()), dtype=np.uint16)
    text[bytesx.ragged(begin, size)] = np.frombuffer(b"".join(regions), np.uint8).astype(np.uint16) + 1
    order = suffixes.suffix_array(text)
    shared = suffixes.common_prefixes(text, order, length)
    weight = np.zeros(len(text), dtype=np.int64)
    weight[bytesx.ragged(begin, counts)] = np.repeat(times, counts)
    group = np.cumsum(shared < length) - 1 if len(order) else order
    total = np.bincount(group, weight[order])
    twice = order[(total[group] > 1) & (weight[order] > 0)]
    twice.sort()
    region = np.searchsorted(begin, twice, side="right") - 1
    return region, twice - begin[region]


def _spans(region: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts: region, first start, last start."""
    if not len(region):
        return region, start, start
    new = np.ones(len(region), dtype=bool)
    new[1:] = (region[1:] != region[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(region)])) - 1
    return region[first], start[first], start[last]


def _removed(size: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return [(a, min(b, size)) for a, b in out]


def repeated_spans(spark: SparkSession, rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, spans: array of (first, last)): starts of windows that start anywhere else too."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b["rid"].to_numpy()
            for i, _, data, offsets in bytesx.slices(b["text"]):
                doc, s0, n, name, body, times = stretches(data, offsets, length)
                yield pa.RecordBatch.from_arrays([
                    bytesx.longs(name), bytesx.longs(body), pa.array(rid[i + doc]), pa.array(s0.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(times.astype(np.int32)),
                ], names=["name", "body", "rid", "s0", "n", "times"])

    kept = repeated(spark, rows.select("rid", "text").mapInArrow(cut, "name long, body long, rid long, s0 int, n int, times int"), "bytes")
    classes = kept.df.groupBy("name", "body").agg(F.sum("times").alias("times"), F.min(F.struct("rid", "s0", "n")).alias("at"))
    variety = classes.groupBy("name").agg(F.count("*").alias("kinds"))
    classes = (
        classes.join(variety, "name")
        .withColumn("pieces", F.ceil(F.col("kinds") / F.lit(HOT)).cast("int"))
        .withColumn("piece", F.pmod("body", "pieces").cast("int"))
    )
    chosen = stash(spark, classes.select("name", "body", "times", "at", "pieces", "piece"), "classes")
    volume = chosen.df.agg(F.sum(F.col("at.n") + F.lit(length))).first()[0] or 0
    shards = max(12, -(-volume // SHARD_BYTES))
    wanted = chosen.df.groupBy(F.col("at.rid").alias("rid")).agg(
        F.collect_list(F.struct(F.col("at.s0").alias("s0"), F.col("at.n").alias("n"), "name", "body", "times", "pieces", "piece")).alias("asked")
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, asked in zip(b["text"], b["asked"].to_pylist(), strict=True):
                raw = text.as_py().encode()
                yield pa.RecordBatch.from_arrays([
                    *(pa.array([a[k] for a in asked], t) for k, t in (("name", pa.int64()), ("body", pa.int64()), ("times", pa.int64()), ("n", pa.int32()), ("pieces", pa.int32()), ("piece", pa.int32()))),
                    pa.array([raw[a["s0"] : a["s0"] + a["n"] + length - 1] for a in asked], pa.binary()),
                ], names=["name", "body", "times", "n", "pieces", "piece", "bytes"])

    regions = with_text(rows, wanted).mapInArrow(fetch, "name long, body long, times long, n int, pieces int, piece int, bytes binary")

    def search(table: pa.Table) -> pa.Table:
        parts = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (table[k] for k in ("name", "body", "times", "n", "pieces"))]
        name, body, times, n, pieces = (np.asarray(x) for x in parts)
        texts = table["bytes"].to_pylist()
        region, start = _repeats(texts, n.astype(np.int64), times, length)
        which, first, last = _spans(region, start)
        out = [pa.table({
            "name": name[which], "body": body[which], "first": first.astype(np.int32), "last": last.astype(np.int32),
            "range": pa.nulls(len(which), pa.int32()), "digests": pa.nulls(len(which), pa.binary()), "places": pa.nulls(len(which), pa.binary()),
        })]
        # Names that other shards hold too: their windows, sorted by digest, one row for each range.
        for x in np.unique(name[pieces > 1]):
            mine = np.flatnonzero(name == x)
            known = set(zip(region[np.isin(region, mine)].tolist(), start[np.isin(region, mine)].tolist(), strict=True))
            raw = np.frombuffer(b"".join(texts[i] for i in mine), np.uint8)
            size = np.array([len(texts[i]) for i in mine])
            begin = np.concatenate(([0], np.cumsum(size)))[:-1]
            at = bytesx.ragged(begin, n[mine].astype(np.int64))
            digest = bytesx.Runs(raw, salt=0xD16E57)(at, at + length)
            owner = np.repeat(mine, n[mine])
            place = at - np.repeat(begin, n[mine])
            loud = np.array([(o, p) in known for o, p in zip(owner.tolist(), place.tolist(), strict=True)], dtype=bool)
            ranges = max(1, int(pieces[mine].max()) * HOT * 100 // RANGE)
            by = np.lexsort((loud, digest))
            digest, owner, place, loud = digest[by], owner[by], place[by], loud[by]
            lane = ((digest >> np.uint64(33)) * np.uint64(ranges)) >> np.uint64(31)
            for r in np.unique(lane):
                s = slice(*np.searchsorted(lane, [r, r + np.uint64(1)]))
                spot = np.rec.fromarrays([body[owner[s]], place[s].astype(np.int32), loud[s]], names="body,place,loud")
                out.append(pa.table({
                    "name": pa.array([x], pa.int64()), "body": pa.nulls(1, pa.int64()), "first": pa.nulls(1, pa.int32()), "last": pa.nulls(1, pa.int32()),
                    "range": pa.array([int(r)], pa.int32()), "digests": pa.array([digest[s].tobytes()], pa.binary()), "places": pa.array([spot.tobytes()], pa.binary()),
                }))
        bytesx.give_back()
        return pa.concat_tables([t.cast(_FOUND) for t in out])

    def merge(table: pa.Table) -> pa.Table:
        """Digests of each shard's run, searched in every shard's."""
        runs = [np.frombuffer(d, np.uint64) for d in table["digests"].to_pylist()]
        spots = [np.frombuffer(p, _SPOT) for p in table["places"].to_pylist()]
        everything = np.sort(np.concatenate(runs), kind="stable")
        body, place = [], []
        for run, spot in zip(runs, spots, strict=True):
            times = np.searchsorted(everything, run, side="right") - np.searchsorted(everything, run, side="left")
            hit = (times > 1) & ~spot["loud"]
            body.append(spot["body"][hit])
            place.append(spot["place"][hit])
        body, place = np.concatenate(body), np.concatenate(place)
        return pa.table({"name": np.full(len(body), table["name"][0].as_py()), "body": body, "first": place, "last": place})

    shard = F.pmod(F.xxhash64("name", "piece"), F.lit(shards)).cast("int")
    found = stash(spark, regions.withColumn("shard", shard).groupBy("shard").applyInArrow(search, "name long, body long, first int, last int, range int, digests binary, places binary"), "found")
    across = found.df.where("range is not null").groupBy("name", "range").applyInArrow(merge, "name long, body long, first int, last int")
    repeats = found.df.where("range is null").select("name", "body", "first", "last").unionByName(across)
    # Every window of a stretch that comes several times in a row repeats.
    last = F.col("s0") + F.when(F.col("times") > 1, F.col("times") * F.col("n") - 1).otherwise(F.col("last"))
    spans = (
        kept.df.select("name", "body", "rid", "s0", "n", "times")
        .join(repeats, ["name", "body"])
        .groupBy("rid")
        .agg(F.collect_list(F.struct((F.col("s0") + F.col("first")).alias("first"), last.alias("last"))).alias("spans"))
    )
    out = stash(spark, spans, "spans")
    for t in (kept, chosen, found):
        t.drop()
    return out.df


_SPOT = np.dtype([("body", np.int64), ("place", np.int32), ("loud", np.bool_)])
_FOUND = pa.schema([
    ("name", pa.int64()), ("body", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("range", pa.int32()), ("digests", pa.binary()), ("places", pa.binary())
])


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, keep_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of ``docs``.

    Removed is each byte covered by a ``length``-byte string that also starts anywhere else in the
    input, the same document included. Null text is the empty text; documents shorter than a window
    keep all; repeated rows are copies of one another and lose all if they hold a window. Ids are
    carried as they are. An empty table gives an empty result.
    """
    rows = numbered(docs)
    spans = repeated_spans(spark, rows, length)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for name, text, found in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["spans"].to_pylist(), strict=True):
                raw = text.encode()
                runs = _removed(len(raw), [(s["first"], s["last"] + length) for s in found or ()])
                at, kept = 0, []
                for a, e in runs:
                    kept.append(raw[at:a])
                    at = e
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((name, len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*out, strict=True)) or [()] * 6
            cells = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(cells[: 5 + keep_bytes], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_bytes])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return rows.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(finish, schema)


def _whole_signs(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left without the runs, each narrowed to whole UTF-8 signs."""
    at, kept = 0, []
    for a, e in runs:
        while a < e and raw[a] & 0xC0 == 0x80:
            a += 1
        while e > a and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        kept.append(raw[at:a])
        at = max(at, e)
    return b"".join((*kept, raw[at:]))


def without_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs``, every column kept, with repeated strings cut out of ``text`` (whole signs only).

    n_chars, if there is such a column, becomes the new text's length where anything was cut. Null texts stay
    null, and a row of which nothing is left has the empty text. Other columns may have any names.
    """
    docs = settled(spark, docs)
    spans = repeated_spans(spark, numbered(docs), length)

    names = docs.columns
    rid, cut = fresh(names, "rid"), fresh(names, "spans")
    rows = docs.withColumn(rid, F.monotonically_increasing_id()).join(spans.select(F.col("rid").alias(rid), F.col("spans").alias(cut)), rid, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = []
            changed = []
            for t, f in zip(b["text"].to_pylist(), b[cut].to_pylist(), strict=True):
                changed.append(bool(t and f))
                if t and f:
                    raw = t.encode()
                    t = _whole_signs(raw, _removed(len(raw), [(s["first"], s["last"] + length) for s in f])).decode()
                text.append(t)
            cells = []
            for name in names:
                if name == "text":
                    cells.append(pa.array(text, b["text"].type))
                elif name == "n_chars":
                    size = [len(t) if c else n for t, c, n in zip(text, changed, b["n_chars"].to_pylist(), strict=True)]
                    cells.append(pa.array(size, b["n_chars"].type))
                else:
                    cells.append(b[name])
            yield pa.RecordBatch.from_arrays(cells, names=names)

    return rows.select(*names, cut).mapInArrow(run, docs.schema)
