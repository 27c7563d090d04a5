"""Removal of every word covered by a long word sequence that starts in an earlier document.

Recompression parses each document's words in rounds. A round names every maximal run of one symbol,
then draws a side for each symbol by a hash of its name, and names every pair of a left and a right
one that are neighbours. Names are 64-bit digests of what they stand for, so all tasks give one thing
one name with no dictionary to exchange. Whether a symbol comes about depends on one neighbour more
each round; that dependence is carried along as the stretch of words that decides it. Equal word
sequences therefore hold equal symbols, except where a symbol's dependence crosses their border.

A window is ``length`` consecutive words of one document. Of the symbols of the highest level up to
ANCHOR_LEVEL that have any whose dependence lies within it, the one with the least hash is its anchor;
single words depend on nothing else, so there always is one.
Windows with one anchor form stretches (see ``occurrences``), and shared symbols reveal candidates:
anchors that occur twice. Copies of a whole stretch are one class, with the least document that holds
it. Where a symbol has classes of several kinds, every window in them is named by a digest of all its
words, and those names are compared, which verifies or refutes each repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import bytesx
from tempora.llm.occurrences import NONE, collapsed, numbered, repeated, with_text
from tempora.llm.scratch import stash

LENGTH = 50
LEVELS = 12
#: Symbols of this level stand for three words on average; higher ones are too few in a window of 50 words.
ANCHOR_LEVEL = 4
#: Most classes of one name that are compared in one place.
HOT = 2_048
#: A document without id counts as later than all others, and as no earlier than one of its kind.
LAST = 2**63 - 1


def levels(words: np.ndarray, offsets: np.ndarray, length: int, rounds: int = LEVELS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, first word, end word of the dependence) of each level's symbols, from single words up.

    ``offsets`` cut the words into documents. Levels end when no symbol's dependence fits a window.
    """
    name = words
    low = np.arange(len(words), dtype=np.int64)
    high = low + 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    yield name, low, high
    for r in range(rounds):
        if not len(name):
            return
        # runs
        joined = np.zeros(len(name), dtype=bool)
        joined[1:] = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
        first = np.flatnonzero(~joined)
        size = np.diff(np.concatenate((first, [len(name)])))
        last = first + size - 1
        same_left = np.zeros(len(first), dtype=bool)
        same_left[1:] = doc[first[1:]] == doc[first[1:] - 1]
        same_right = np.zeros(len(first), dtype=bool)
        same_right[:-1] = doc[last[:-1]] == doc[last[:-1] + 1]
        run_low, run_high = low[first], high[last]
        # That a run is maximal, or a symbol alone, rests on both neighbours; where the document ends, on
        # its end, which no window can see past: such symbols are never used (their dependence is endless).
        new_low = np.where(same_left, low[np.maximum(first - 1, 0)], -(1 << 40))
        new_high = np.where(same_right, high[np.minimum(last + 1, len(name) - 1)], 1 << 40)
        name = np.where(size > 1, bytesx.mix(name[first] + size.astype(np.uint64) * bytesx.M2), name[first])
        low, high, doc = np.minimum(run_low, new_low), np.maximum(run_high, new_high), doc[first]
        # pairs
        left = (bytesx.mix(name + np.uint64(0xA5A5 + r)) & np.uint64(1)).astype(bool)
        beside = np.zeros(len(name), dtype=bool)
        beside[:-1] = doc[1:] == doc[:-1]
        pair = np.zeros(len(name), dtype=bool)
        pair[:-1] = left[:-1] & ~left[1:] & beside[:-1]
        second = np.zeros(len(name), dtype=bool)
        second[1:] = pair[:-1]
        # a left symbol's fate rests on its right neighbour, a right symbol's on its left one
        after = np.where(beside, np.concatenate((high[1:], [0])), 1 << 40)
        before = np.where(np.concatenate(([False], beside[:-1])), np.concatenate(([0], low[:-1])), -(1 << 40))
        high2 = np.where(left, after, high)
        low2 = np.where(left, low, before)
        low2[pair] = low[pair]
        keep = ~second
        at = np.flatnonzero(pair)
        fresh = name.copy()
        fresh[at] = bytesx.mix(name[at] * bytesx.M1 + bytesx.mix(name[at + 1]) + np.uint64(1))
        name, low, high, doc = fresh[keep], low2[keep], high2[keep], doc[keep]
        if not (high - low <= length).any():
            return
        yield name, low, high


def stretches(words: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first start, number of starts, anchor name, body digest, times in a row) of every stretch."""
    sizes = np.diff(offsets)
    whole = sizes >= length
    starts = bytesx.ragged(offsets[:-1][whole], sizes[whole] - length + 1)
    if not len(starts):
        return NONE
    n = len(words)
    anchor = np.zeros(n, dtype=np.uint64)
    spot = np.zeros(n, dtype=np.int64)
    open_ = starts
    for level, (name, low, high) in reversed(list(enumerate(levels(words, offsets, length, ANCHOR_LEVEL)))):
        usable = np.flatnonzero((high - low <= length) & (low >= 0))
        if not len(usable):
            continue
        lo, hi, called = low[usable], high[usable], bytesx.mix(name[usable] + np.uint64(level * 0x632BE59BD9B4E019 % 2**64))
        # the symbols whose dependence lies within each window are consecutive: take the least of them
        first = np.searchsorted(lo, open_)
        count = np.searchsorted(hi, open_ + length, side="right") - first
        ok = count > 0
        done, first, count = open_[ok], first[ok], count[ok]
        value = (called & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(called), dtype=np.uint64)
        best, have = np.full(len(done), np.iinfo(np.uint64).max), 1
        while len(done):
            now = np.flatnonzero((count >= have) & (count < 2 * have))
            best[now] = np.minimum(value[first[now]], value[first[now] + count[now] - have])
            if 2 * have > count.max():
                break
            value = np.minimum(value, np.concatenate((value[have:], np.full(min(have, len(value)), np.iinfo(np.uint64).max))))
            have *= 2
        mark = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
        anchor[done], spot[done] = called[mark], lo[mark]
        open_ = open_[~ok]
        if not len(open_):
            break
    name, place = anchor[starts], spot[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (name[1:] != name[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(starts)])))
    s0 = starts[first]
    body = bytesx.Sequence(words, salt=0xB0D2)(s0, s0 + count + length - 1)
    doc = np.searchsorted(offsets, s0, side="right") - 1
    return collapsed(doc, s0 - offsets[doc], count, name[first], body)


def _names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digests of the words, word offsets of the documents)."""
    starts, ends, counts = bytesx.words(data, offsets)
    return bytesx.Runs(data)(starts, ends), np.concatenate(([0], np.cumsum(counts)))


def earlier_windows(spark: SparkSession, rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, spans: array of (first, last)): windows at those words start in an earlier document too.

    Of the occurrences of one class all but those in its least document are repeats as a whole. So only for
    the least document it matters which of the class's windows other classes hold in earlier documents.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, ids = b["rid"].to_numpy(), b["doc_id"].fill_null(LAST).to_numpy()
            for i, _, data, offsets in bytesx.slices(b["text"]):
                doc, s0, n, name, body, times = stretches(*_names(data, offsets), length)
                yield pa.RecordBatch.from_arrays([
                    bytesx.longs(name), bytesx.longs(body), pa.array(rid[i + doc]), pa.array(ids[i + doc]), pa.array(s0.astype(np.int32)), pa.array(n.astype(np.int32)),
                    pa.array(times.astype(np.int32)),
                ], names=["name", "body", "rid", "doc", "s0", "n", "times"])

    kept = repeated(spark, rows.select("rid", "doc_id", "text").mapInArrow(cut, "name long, body long, rid long, doc long, s0 int, n int, times int"), "words")
    classes = kept.df.groupBy("name", "body").agg(F.min("doc").alias("least"), F.min(F.struct("rid", "s0", "n")).alias("at"))
    variety = classes.groupBy("name").agg(F.count("*").alias("kinds"))
    chosen = stash(spark, classes.join(variety, "name"), "classes")

    def name_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked_of = b["asked"].to_pylist()
            for i, j, data, offsets in bytesx.slices(b["text"]):
                words, cut_at = _names(data, offsets)
                asked = [(d - i, a) for d in range(i, j) for a in asked_of[d]]
                n = np.array([a["n"] for _, a in asked], dtype=np.int64)
                at = bytesx.ragged(np.array([cut_at[d] + a["s0"] for d, a in asked], dtype=np.int64), n)
                window = bytesx.Sequence(words, salt=0x71D)(at, at + length)
                cells = [pa.array([a[k] for _, a in asked], pa.int64()) for k in ("name", "body", "least")]
                yield pa.RecordBatch.from_arrays([*cells, bytesx.binaries(window.view(np.uint8), np.concatenate(([0], np.cumsum(n))) * 8)], names=["name", "body", "least", "windows"])

    def named(of: DataFrame) -> DataFrame:
        wanted = of.groupBy(F.col("at.rid").alias("rid")).agg(
            F.collect_list(F.struct(F.col("at.s0").alias("s0"), F.col("at.n").alias("n"), "name", "body", "least")).alias("asked")
        )
        return with_text(rows, wanted).mapInArrow(name_windows, "name long, body long, least long, windows binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Classes of one name after another, from a stream sorted by name; a name has HOT classes at most."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            name = b["name"].to_numpy()
            at = int(np.searchsorted(name, name[-1]))
            if at or held and held[-1]["name"][0].as_py() != name[0]:
                if at:
                    held.append(b.slice(0, at))
                yield _early(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(at))
        if held:
            yield _early(pa.Table.from_batches(held))

    early = "name long, body long, early array<struct<first:int,last:int>>"
    found = named(chosen.df.where(F.col("kinds").between(2, HOT))).repartition("name").sortWithinPartitions("name").mapInArrow(compare, early)
    judged = [stash(spark, found, "early")]
    often = chosen.df.where(F.col("kinds") > HOT)
    if not often.isEmpty():
        # A name with so many classes is not gathered: its windows are rows, and meet by their own names.
        size = F.octet_length("windows") / 8
        each = F.transform(F.sequence(F.lit(0), (size - 1).cast("int")), lambda i: F.substring(F.hex("windows"), i * 16 + 1, F.lit(16)))
        windows = stash(spark, named(often).select("name", "body", "least", F.posexplode(each).alias("i", "window")), "windows")
        first = windows.df.groupBy("name", "window").agg(F.min("least").alias("first_doc"))
        hit = windows.df.join(first, ["name", "window"]).where("first_doc < least")
        spans = hit.groupBy("name", "body").agg(F.collect_list(F.struct(F.col("i").alias("first"), F.col("i").alias("last"))).alias("early"))
        judged.append(stash(spark, spans, "early-often"))
        windows.drop()
    partly = judged[0].df
    for more in judged[1:]:
        partly = partly.union(more.df)
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("n") * F.col("times") - 1).alias("last")))
    later = kept.df.join(chosen.df.select("name", "body", "least"), ["name", "body"]).where("doc > least").select("rid", "s0", whole.alias("hits"))
    least = chosen.df.select("name", "body", F.col("least").alias("doc"))
    shift = lambda h, k: F.struct((h["first"] + k * F.col("n")).alias("first"), (h["last"] + k * F.col("n")).alias("last"))
    again = F.flatten(F.transform(F.sequence(F.lit(0), F.col("times") - 1), lambda k: F.transform("early", lambda h: shift(h, k))))
    firsts = kept.df.join(partly.where(F.size("early") > 0), ["name", "body"]).join(least, ["name", "body", "doc"]).select("rid", "s0", again.alias("hits"))
    moved = F.transform("hits", lambda h: F.struct((h["first"] + F.col("s0")).alias("first"), (h["last"] + F.col("s0")).alias("last")))
    spans = later.union(firsts).select("rid", moved.alias("spans")).groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = stash(spark, spans, "spans")
    for t in (kept, chosen, *judged):
        t.drop()
    return out.df


def _early(table: pa.Table) -> pa.RecordBatch:
    """Of each class the windows that a class of the same name with an earlier least document holds too."""
    name, body, least = (table[k].to_numpy() for k in ("name", "body", "least"))
    _, _, data, offsets = next(bytesx.slices(table["windows"].combine_chunks(), 1 << 40))
    window = np.frombuffer(data.tobytes(), np.uint64)
    count = np.diff(offsets) // 8
    owner = np.repeat(np.arange(len(name)), count)
    key, back = np.unique(bytesx.mix(window + name.view(np.uint64)[owner] * bytesx.M1), return_inverse=True)
    first = np.full(len(key), LAST)
    np.minimum.at(first, back, least[owner])
    place = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    hit = np.flatnonzero(first[back] < least[owner])
    o, p = owner[hit], place[hit]
    new = np.ones(len(hit), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)
    at = np.flatnonzero(new)
    end = np.concatenate((at[1:], [len(hit)])) - 1
    spans = pa.StructArray.from_arrays([pa.array(p[at].astype(np.int32)), pa.array(p[end].astype(np.int32))] if len(hit) else [pa.array([], pa.int32())] * 2, names=["first", "last"])
    cuts = np.searchsorted(o[at] if len(hit) else np.zeros(0, np.int64), np.arange(len(name) + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(name), pa.array(body), pa.ListArray.from_arrays(pa.array(cuts), spans)], names=["name", "body", "early"])


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for every row of ``docs``.

    Removed is each word covered by a window of ``length`` words whose sequence also starts in a row
    with a smaller doc_id. Kept words are joined by one space. Null text has no words. Null ids count
    as larger than every id, and rows with one id are not earlier than each other. An empty table
    gives an empty result.
    """
    rows = numbered(docs)
    spans = earlier_windows(spark, rows, length)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for name, text, found in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["spans"].to_pylist(), strict=True):
                words = text.encode().split()
                total = len(words)
                if found:
                    edge = np.zeros(total + 1, dtype=np.int64)
                    np.add.at(edge, [m["first"] for m in found], 1)
                    np.add.at(edge, [m["last"] + length for m in found], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                left = b" ".join(words)
                out.append((name, total, total - len(words), hashlib.sha256(left).hexdigest(), left.decode()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            cells = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(cells[: 4 + keep_text], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + keep_text])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return rows.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(finish, schema)
