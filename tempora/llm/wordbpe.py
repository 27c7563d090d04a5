"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

A text is cut before every run of ASCII white space, so a word here is such a run with what
follows it. No match of the pre-token pattern spans such a cut (every alternative ends where white
space begins, and white space is only at a match's start, or the whole of it), so the ids of a text
are the ids of its words, one after another.

1. Words are exploded, distinct within a task, then distinct over the whole corpus by one shuffle;
   each distinct word is cut by the pattern and encoded once.
2. Bundles of documents ask for their distinct words: one row for each bundle and hash block holds
   the sorted word hashes. Vocabulary rows and requests meet in their block, in one sorted stream
   that holds one block of the vocabulary and one request at a time, and replies go back.
3. Each bundle's text and replies meet again; ids are put together by position.
4. Decoding joins ids to the token-byte table, which has one row for each token, and checks that
   the bytes are the text's.

Words with one 64-bit digest are told apart: such a word has an empty entry in the vocabulary, and the
bundle encodes it itself; so does a bundle with any word that the ids it got do not spell. Documents move once, compressed; frequent words never gather anywhere,
since a task and a bundle name each word once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import bytesx
from tempora.llm.scratch import bundles, settled, small_batches, stash

#: Rows of a bundle, and bytes of text that end one.
BUNDLE, BUNDLE_BYTES = 4_000, 16_000_000
WORDS_PER_BLOCK = 50_000
LEVEL = 6
#: Distinct word hashes that a task remembers before it may name a word again.
REMEMBER = 4_000_000


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-document counts of words with the white space before them."""
    space = bytesx._IS_SPACE[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    at = np.flatnonzero(cut)
    # A cut after white space beyond ASCII could part one run of white space: leave it out. The
    # test takes in some other signs of the same UTF-8 blocks, which only makes longer words.
    b1, b2, b3 = (np.where(at >= k, data[at - k], 0) for k in (1, 2, 3))
    wide = ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81))) | ((b3 == 0xE3) & (b2 == 0x80)) | ((b3 == 0xE1) & (b2 == 0x9A))
    flags = np.zeros(len(data) + 1, dtype=bool)
    flags[at[~wide]] = True
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    flags[first] = True
    flags[len(data)] = False
    starts = np.flatnonzero(flags)
    ends = np.concatenate((starts[1:], [len(data)])) if len(starts) else starts
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


class Ranks:
    """The rank file's library tokenizer and its token-byte table."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            table[i] = token
        size = np.array([len(x) for x in table], dtype=np.int64)
        self.size, self.start = size, np.concatenate(([0], np.cumsum(size)[:-1]))
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.kind = np.dtype("<u2" if len(table) <= 65_536 else "<u4")

    def encode(self, word: bytes) -> list[int]:
        return self.encoding.encode_ordinary(word.decode())

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, byte count of each id): the join of ids with the token-byte table."""
        ids = ids.astype(np.int64)
        size = self.size[ids]
        return self.bytes[bytesx.ragged(self.start[ids], size)], size


_loaded: dict[tuple[str, str], Ranks] = {}


def _ranks(path: str, pattern: str) -> Ranks:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Ranks(path, pattern)
    return _loaded[path, pattern]


def _block(h: Column, blocks: int) -> Column:
    return F.shiftright(F.shiftrightunsigned(h, 33) * F.lit(blocks), 31).cast("int")


def _blocks_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(33)) * np.uint64(blocks)) >> np.uint64(31)


def vocabulary(spark: SparkSession, docs: DataFrame, path: str, pattern: str):
    """Write (h, ids) of every distinct word of ``docs.text``, each encoded once."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        fresh: list[np.ndarray] = []
        for b in batches:
            for _, _, data, offsets in bytesx.slices(b["text"], 2_000_000):
                starts, ends, _ = pieces(data, offsets)
                # By another digest than the vocabulary's: words that one of them takes for each other differ in the other.
                h, first = np.unique(bytesx.Runs(data, salt=0x3D)(starts, ends), return_index=True)
                new = np.ones(len(h), dtype=bool)
                for known in (seen, *fresh):
                    if len(known):
                        where = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        new &= known[where] != h
                first = first[new]
                fresh.append(h[new])
                if len(fresh) > 8:
                    seen = np.sort(np.concatenate((seen, *fresh)))
                    fresh = []
                    if len(seen) > REMEMBER:
                        seen = np.zeros(0, np.uint64)
                size = ends[first] - starts[first]
                yield pa.RecordBatch.from_arrays([bytesx.binaries(data[bytesx.ragged(starts[first], size)], np.concatenate(([0], np.cumsum(size))))], names=["word"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(path, pattern)
        for b in batches:
            words = b["word"].to_pylist()
            ids = [ranks.encode(w) for w in words]
            size = np.array([len(x) for x in ids], dtype=np.int64)
            flat = np.array([i for x in ids for i in x], dtype=ranks.kind)
            _, _, data, offsets = next(bytesx.slices(b["word"], 1 << 40), (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
            h = bytesx.Runs(data)(offsets[:-1], offsets[1:])
            yield pa.RecordBatch.from_arrays(
                [bytesx.longs(h), bytesx.binaries(flat.view(np.uint8), np.concatenate(([0], np.cumsum(size))) * ranks.kind.itemsize)], names=["h", "ids"]
            )

    words = docs.select("text").mapInArrow(explode, "word binary").distinct()
    return stash(spark, words.mapInArrow(encode, "h long, ids binary"), "vocabulary")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Stretches of rows with one key in a stream sorted by it, in pieces as they come."""
    for b in batches:
        if b.num_rows:
            k = b[key].to_numpy(zero_copy_only=False)
            at = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
            for i, j in zip(at[:-1], at[1:], strict=True):
                yield int(k[i]), b.slice(i, j - i)


def encode_texts(spark: SparkSession, docs: DataFrame, path: str, pattern: str, *, bundle: int = BUNDLE, words_per_block: int = WORDS_PER_BLOCK, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text.

    Null text is the empty text, with no ids. Ids of rows are carried as they are, null or repeated;
    a row is known by its place in the input. An empty table gives an empty result. With ``keep_ids``
    the ids come too, as little-endian unsigned 32-bit integers.
    """
    small_batches(spark)
    rows = settled(spark, docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    vocab = vocabulary(spark, rows, path, pattern)
    blocks = max(8, -(-vocab.df.count() // words_per_block))
    itemsize = _ranks(path, pattern).kind.itemsize
    placed = rows.withColumn("place", F.monotonically_increasing_id())

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        return bundles(batches, bundle, BUNDLE_BYTES, "text", "place")

    def hashes(text: pa.Array) -> np.ndarray:
        found = []
        for _, _, data, offsets in bytesx.slices(text):
            starts, ends, _ = pieces(data, offsets)
            found.append(np.unique(bytesx.Runs(data)(starts, ends)))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, t in collect(batches):
            h = hashes(t["text"].combine_chunks())
            at = np.searchsorted(_blocks_of(h, blocks), np.arange(blocks + 1))
            some = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([
                pa.array(some.astype(np.int32)), pa.array(np.full(len(some), k, np.int64)), pa.array([h[at[i] : at[i + 1]].tobytes() for i in some], pa.binary()),
            ], names=["block", "bundle", "asked"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, table = None, [], None
        for k, b in _runs(batches, "block"):
            if k != block:
                block, parts, table = k, [], None
            mine = b["bundle"].is_null().to_numpy(zero_copy_only=False)
            if mine.any():
                parts.append(b.filter(pa.array(mine)))
            b = b.filter(pa.array(~mine))
            if not b.num_rows:
                continue
            if table is None:
                known = pa.Table.from_batches(parts) if parts else None
                parts = []
                h = known["h"].to_numpy().view(np.uint64) if known else np.zeros(0, np.uint64)
                order = np.argsort(h, kind="stable")
                _, _, data, offsets = next(bytesx.slices(known["ids"].combine_chunks(), 1 << 40)) if known else (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64))
                h, start, size = h[order], offsets[:-1][order], np.diff(offsets)[order]
                twin = np.zeros(len(h), dtype=bool)
                twin[1:] |= h[1:] == h[:-1]
                twin[:-1] |= h[1:] == h[:-1]
                table = h, start, np.where(twin, 0, size), data
            h, start, size, data = table
            out: tuple[list, list] = ([], [])
            for asked in b["asked"].to_pylist():
                want = np.frombuffer(asked, np.uint64)
                where = np.minimum(np.searchsorted(h, want), max(len(h) - 1, 0))
                many = np.where(h[where] == want, size[where], 0) if len(h) else np.zeros(len(want), np.int64)
                out[0].append((many // itemsize).astype("<u4").tobytes())
                out[1].append(data[bytesx.ragged(start[where], many)].tobytes() if len(h) else b"")
            yield pa.RecordBatch.from_arrays([b["bundle"], b["block"], pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=["bundle", "block", "counts", "ids"])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=LEVEL)
        for k, t in collect(batches):
            body = b"".join(x.encode() for x in t["text"].to_pylist())
            sizes = np.diff(next(bytesx.slices(t["text"].combine_chunks(), 1 << 40))[3])
            yield pa.RecordBatch.from_arrays([
                pa.array([k], pa.int64()), pa.array([-1], pa.int32()), pa.array([z.compress(body)], pa.binary()), pa.array([sizes.tolist()], pa.list_(pa.int64())),
                pa.array([t["doc_id"].to_pylist()], pa.list_(pa.int64())),
            ], names=["bundle", "block", "z", "sizes", "names"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, text, counts, ids, last = _ranks(path, pattern), None, [], [], None
        for k, b in _runs(batches, "bundle"):
            if k != last:
                if last is not None:
                    yield from finish(ranks, text, counts, ids)
                text, counts, ids, last = None, [], [], k
            for row in b.to_pylist():
                if row["block"] < 0:
                    text = row
                else:
                    counts.append(row["counts"])
                    ids.append(row["ids"])
        if last is not None:
            yield from finish(ranks, text, counts, ids)

    def spelt(size: np.ndarray, width: np.ndarray, plain: np.ndarray, ends: np.ndarray, data: np.ndarray) -> bool:
        """Whether the ids of each word, ``size`` of them, decode to that word."""
        return np.array_equal(np.concatenate(([0], np.cumsum(width)))[np.cumsum(size)], ends) and np.array_equal(plain, data)

    def finish(ranks: Ranks, text: dict, counts: list[bytes], ids: list[bytes]) -> Iterator[pa.RecordBatch]:
        many = np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
        flat = np.frombuffer(b"".join(ids), ranks.kind).astype(np.uint32)
        begin = np.concatenate(([0], np.cumsum(many)))[:-1]
        offsets = np.concatenate(([0], np.cumsum(text["sizes"]))).astype(np.int64)
        body = zstandard.ZstdDecompressor().decompress(text["z"], max_output_size=max(1, int(offsets[-1])))
        column = bytesx.binaries(np.frombuffer(body, np.uint8), offsets)
        parts = list(bytesx.slices(column))
        found = []
        for _, _, data, cut in parts:
            starts, ends, per = pieces(data, cut)
            found.append((bytesx.Runs(data)(starts, ends), starts, ends, per))
        # the order in which ``ask`` listed them
        asked = np.unique(np.concatenate([np.unique(f[0]) for f in found])) if found else np.zeros(0, np.uint64)
        for (i, j, data, cut), (h, starts, ends, per) in zip(parts, found, strict=True):
            where = np.searchsorted(asked, h)
            size = many[where]
            out = flat[bytesx.ragged(begin[where], size)]
            plain, width = ranks.decode(out)
            if not spelt(size, width, plain, ends, data):
                # A word whose digest another word has too: every word that its ids do not spell is encoded here.
                local = []
                for s, e, w, n in zip(starts.tolist(), ends.tolist(), where.tolist(), size.tolist(), strict=True):
                    ids, word = flat[begin[w] : begin[w] + n], data[s:e]
                    local.append(ids if np.array_equal(ranks.decode(ids)[0], word) else np.array(ranks.encode(word.tobytes()), dtype=np.uint32))
                size = np.array([len(x) for x in local], dtype=np.int64)
                out = np.concatenate(local)
                plain, width = ranks.decode(out)
                if not spelt(size, width, plain, ends, data):
                    raise ValueError("decoded ids differ from the text")
            at = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(per)))]
            ends_of = np.concatenate(([0], np.cumsum(width)))[at]
            raw, plain = out.astype("<u4").tobytes(), plain.tobytes()
            cells = [
                pa.array(text["names"][i:j], pa.int64()), pa.array(np.diff(at)),
                pa.array([hashlib.sha256(raw[4 * s : 4 * e]).hexdigest() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]),
                pa.array([hashlib.sha256(plain[s:e]).hexdigest() for s, e in zip(ends_of[:-1].tolist(), ends_of[1:].tolist(), strict=True)]),
            ]
            if keep_ids:
                cells.append(bytesx.binaries(np.frombuffer(raw, np.uint8), at * 4))
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cells)])

    none = lambda kind: F.lit(None).cast(kind)
    words = vocab.df.select(_block(F.col("h"), blocks).alias("block"), "h", "ids", none("long").alias("bundle"), none("binary").alias("asked"))
    asks = placed.select("place", "text").mapInArrow(ask, "block int, bundle long, asked binary").select(
        "block", none("long").alias("h"), none("binary").alias("ids"), "bundle", "asked"
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)
    replies = (
        words.unionByName(asks).repartition(tasks, "block").sortWithinPartitions("block", F.col("bundle").asc_nulls_first())
        .mapInArrow(answer, "bundle long, block int, counts binary, ids binary")
    )
    # Written here, so that the requests' and the vocabulary's shuffle files are gone when the texts move.
    answered = stash(spark, replies, "replies")
    vocab.drop()
    replies = (
        answered.df.select("bundle", "block", "counts", "ids", none("binary").alias("z"), none("array<long>").alias("sizes"), none("array<long>").alias("names"))
    )
    texts = placed.mapInArrow(squeeze, "bundle long, block int, z binary, sizes array<long>, names array<long>").select(
        "bundle", "block", none("binary").alias("counts"), none("binary").alias("ids"), "z", "sizes", "names"
    )
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return replies.unionByName(texts).repartition(tasks, "bundle").sortWithinPartitions("bundle", "block").mapInArrow(assemble, schema)
