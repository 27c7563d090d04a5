"""Token ids in a file format with Re-Pair grammar compression, one grammar for each shard.

Re-Pair: frequent pairs of neighbouring symbols are replaced by new symbols (nonterminals), again
and again, until no pair comes LEAST_COUNT times. Here each round replaces many pairs at once; where
occurrences overlap, every other one of a chain is taken, from the left. A shard stores the rules,
the expansion length of every nonterminal, the final symbol sequence and the documents' lengths.
The lengths give each symbol's place among the ids, so any range of ids is decoded by expanding
only the symbols that meet it.

Shard layout, little-endian: magic, then counts (documents u32, rules u32, base u32, symbol width
in bytes u32, symbols u64, ids u64), document lengths u32, rules (pairs of symbols), expansion
lengths u32, symbols. Shards are rows of a Parquet table in ascending order of documents.
"""

from __future__ import annotations

import itertools
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm import bytesx
from tempora.llm.scratch import stash

MAGIC = b"RPG1"
_HEAD = "<4sIIIIQQ"
SHARD_IDS = 1_000_000
LEAST_COUNT = 12
#: A round takes pairs down to this part of the highest count.
SHARE = 8
END_ID = 1
#: Words that a worker keeps encoded; when there are more it starts afresh.
CACHE = 500_000


def _slot(key: np.ndarray) -> np.ndarray:
    bits = key.dtype.itemsize * 8
    return (key * key.dtype.type(0x9E3779B97F4A7C15 >> (64 - bits) | 1)) >> key.dtype.type(bits - 20)


def compress(ids: np.ndarray, base: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules of shape (r, 2), expansion lengths of the rules) of ids below ``base``.

    Each round replaces the pairs that come at least a SHARE-th as often as the most frequent one, until
    no pair comes ``least`` times. A pair of old symbols only gets rarer, so a round counts the places alone
    whose pair was frequent before or holds a new symbol.
    """
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    lengths = np.ones(base, dtype=np.uint32)
    live = np.arange(len(seq) - 1)
    while len(live):
        wide = len(lengths) > 65_536
        if 2 * len(live) > len(seq):
            key = ((seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:] if wide else (seq[:-1] << np.uint32(16)) | seq[1:])[live]
        else:
            key = (seq[live].astype(np.uint64) << np.uint64(32)) | seq[live + 1] if wide else (seq[live] << np.uint32(16)) | seq[live + 1]
        ordered = np.sort(key)
        at = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
        counts = np.diff(np.concatenate((at, [len(ordered)])))
        top = int(counts.max())
        if top < least:
            break
        chosen = ordered[at[np.flatnonzero(counts >= max(least, top // SHARE))]]
        # By slot: 0 where a pair is frequent, the pair's number from 1 where one is chosen; pairs that meet are told apart by search.
        state = np.full(1 << 20, -1, dtype=np.int32)
        state[_slot(ordered[at[np.flatnonzero(counts >= least)]])] = 0
        state[_slot(chosen)] = np.arange(1, len(chosen) + 1)
        state = state[_slot(key)]
        maybe = np.flatnonzero(state > 0)
        where, wanted = state[maybe] - 1, key[maybe]
        other = np.flatnonzero(chosen[where] != wanted)
        where[other] = np.minimum(np.searchsorted(chosen, wanted[other]), len(chosen) - 1)
        hit = np.ones(len(maybe), dtype=bool)
        hit[other] = chosen[where[other]] == wanted[other]
        place, where = live[maybe[hit]], where[hit]
        chain = np.concatenate(([True], np.diff(place) > 1))
        first = place[np.flatnonzero(chain)][np.cumsum(chain) - 1]
        take = (place - first) % 2 == 0
        place, where = place[take], where[take]
        used = np.bincount(where, minlength=len(chosen)) > 0
        pairs = chosen[used]
        shift = 32 if wide else 16
        left, right = (pairs >> pairs.dtype.type(shift)).astype(np.uint32), (pairs & pairs.dtype.type((1 << shift) - 1)).astype(np.uint32)
        seq[place] = (len(lengths) + np.cumsum(used) - 1).astype(np.uint32)[where]
        keep = np.ones(len(seq), dtype=bool)
        keep[place + 1] = False
        # The new symbols' pairs start at them and one before; what starts at a removed place goes with it.
        alive = np.zeros(len(seq), dtype=bool)
        alive[live] = state >= 0
        alive[place] = True
        alive[np.maximum(place - 1, 0)] = True
        seq, live = seq[keep], np.flatnonzero(alive[keep])
        live = live[live < len(seq) - 1]
        rules.append(np.column_stack((left, right)))
        lengths = np.concatenate((lengths, lengths[left] + lengths[right]))
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), lengths[base:]


def _narrow(symbols: np.ndarray, width: int) -> bytes:
    """Little-endian unsigned integers of ``width`` bytes."""
    return np.ascontiguousarray(symbols.astype("<u4").reshape(-1, 1).view(np.uint8)[:, :width]).tobytes()


def _widened(blob: bytes, count: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((count, 4), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, count * width, at).reshape(count, width)
    return out.view("<u4").ravel()


def _expanded(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    seq = seq.astype(np.int64)
    while True:
        inner = seq >= base
        if not inner.any():
            return seq.astype(np.uint32)
        out = np.zeros(len(seq) + int(inner.sum()), dtype=np.int64)
        place = np.arange(len(seq)) + np.concatenate(([0], np.cumsum(inner)[:-1]))
        out[place] = seq
        out[place[inner]] = rules[seq[inner] - base, 0]
        out[place[inner] + 1] = rules[seq[inner] - base, 1]
        seq = out


def expand(seq: np.ndarray, rules: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for; ``span`` has how many each one does. Every rule among them is expanded once."""
    base = len(span) - len(rules)
    used = np.zeros(len(span), dtype=bool)
    used[seq] = True
    needed = base + np.flatnonzero(used[base:])
    pool = np.concatenate((np.arange(base, dtype=np.uint32), _expanded(needed, rules, base)))
    start = np.arange(len(span))
    start[needed] = base + np.cumsum(span[needed]) - span[needed]
    return pool[bytesx.ragged(start[seq], span[seq])]


def pack(ids: np.ndarray, sizes: np.ndarray, base: int) -> bytes:
    seq, rules, lengths = compress(ids, base)
    width = next(w for w in (2, 3, 4) if base + len(rules) <= 1 << 8 * w)
    head = struct.pack(_HEAD, MAGIC, len(sizes), len(rules), base, width, len(seq), len(ids))
    return b"".join((head, sizes.astype("<u4").tobytes(), _narrow(rules, width), lengths.astype("<u4").tobytes(), _narrow(seq, width)))


class Shard:
    """A shard read from its bytes; ``ids(i, j)`` decodes any range of its ids."""

    def __init__(self, blob: bytes):
        magic, docs, rules, self.base, width, symbols, self.n = struct.unpack_from(_HEAD, blob)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at = struct.calcsize(_HEAD)
        parts = []
        for w, count in ((4, docs), (width, 2 * rules), (4, rules), (width, symbols)):
            parts.append(_widened(blob, count, w, at))
            at += w * count
        self.sizes, self.rules, self.lengths, self.symbols = parts[0], parts[1].reshape(-1, 2), parts[2], parts[3]
        self.span = np.concatenate((np.ones(self.base, np.int64), self.lengths.astype(np.int64)))
        self.ends = np.cumsum(self.span[self.symbols])

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(self.ends, [start, end - 1], side="right")
        skipped = int(self.ends[i - 1]) if i else 0
        return expand(self.symbols[i : j + 1], self.rules, self.span)[start - skipped : end - skipped]

    def document(self, k: int) -> np.ndarray:
        start = int(self.sizes[:k].sum())
        return self.ids(start, start + int(self.sizes[k]))


#: The way of cutting texts that ``_pieces`` and ``WordEncoder._encode`` rest on, as tokenizer files state it.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "end_of_word_suffix": "</w>",
}
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The sign that stands for each byte in a byte-level vocabulary. The space stays, since it parts words here.
_SIGN = np.zeros(256, dtype="<u4")
_SIGN[_PRINTED] = _PRINTED
_SIGN[_SIGN == 0] = np.arange(256, 512 - len(_PRINTED))
_SIGN[32] = 32


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words without A-Z, cut again where an ASCII mark follows a letter up to U+00FF: no piece of the tokenizer spans that.

    A letter after a mark is no such place (an apostrophe may belong to the letters after it).
    """
    starts, ends, _ = bytesx.words(data, offsets)
    first = np.zeros(len(data) + 1, dtype=bool)
    last = np.zeros(len(data) + 1, dtype=bool)
    letter = data - np.uint8(97) < 26
    mark = (data - np.uint8(33) < 94) & ~letter & (data - np.uint8(48) > 9)
    # The letters from U+00C0 on are the byte C3 and one more; two of those are signs.
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = np.flatnonzero(letter[:-1] & mark[1:]) + 1
    first[starts], first[cut] = True, True
    last[ends], last[cut] = True, True
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last), np.diff(np.searchsorted(starts, offsets))


#: Latin small letters, which the tokenizer neither changes nor cuts.
_plain = re.compile(f"[{''.join(c for c in map(chr, range(0x250)) if c.isalpha() and c == c.lower())}]+").fullmatch


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct value, which of them each value is)."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(values), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def _grown(array: np.ndarray, n: int) -> np.ndarray:
    """``array`` with room for ``n`` values."""
    if n <= len(array):
        return array
    out = np.zeros(max(n, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


class WordEncoder:
    """Ids of whole texts through a library tokenizer.

    Where the file cuts texts as KNOWN says, no piece spans white space, and each distinct word is encoded once
    while the worker remembers it. Texts go to the library whole with any other file.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        stated = {"normalizer": file.get("normalizer"), "pre_tokenizer": file.get("pre_tokenizer"), "end_of_word_suffix": file["model"].get("end_of_word_suffix")}
        self.by_word = stated == KNOWN and file["model"].get("dropout") is None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        #: No added token is looked for in words of letters.
        self.straight = all(t["special"] for t in file.get("added_tokens") or [])
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.closes = np.zeros(self.base, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.closes[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        #: Numbers of words by the low bits of their digests, the next free slot where those meet.
        self.slots = np.full(1 << 20, -1, np.int32)
        self.known = self.used = self.filled = 0
        self.digest = np.zeros(1 << 16, np.uint64)
        #: Each word's bytes, in blocks of eight, and its ids.
        self.size, self.block, self.start, self.count = (np.zeros(1 << 16, np.int64) for _ in range(4))
        self.blocks = np.zeros(1 << 18, np.uint64)
        self.flat = np.zeros(1 << 18, np.uint32)

    def _find(self, digests: np.ndarray) -> np.ndarray:
        """Numbers of the words with these digests, -1 where there is none."""
        found, mask = np.full(len(digests), -1, np.int64), len(self.slots) - 1
        todo, at = np.arange(len(digests)), (digests & np.uint64(mask)).astype(np.int64)
        while len(todo):
            number = self.slots[at]
            hit = (number >= 0) & (self.digest[number] == digests[todo])
            found[todo[hit]] = number[hit]
            more = (number >= 0) & ~hit
            todo, at = todo[more], (at[more] + 1) & mask
        return found

    def _enter(self, numbers: np.ndarray) -> None:
        """Let words be found by their digests, which differ."""
        mask = len(self.slots) - 1
        at = (self.digest[numbers] & np.uint64(mask)).astype(np.int64)
        while len(at):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            more = self.slots[at] != numbers
            numbers, at = numbers[more], (at[more] + 1) & mask

    def _equal(self, numbers: np.ndarray, eight: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether known words have the bytes of the words at ``starts``."""
        ok = self.size[numbers] == size
        if ok.any():
            blocks, n = bytesx.blocks(eight, starts[ok], size[ok])
            same = self.blocks[bytesx.ragged(self.block[numbers[ok]], n)] == blocks
            ok[ok] = np.logical_and.reduceat(same, np.cumsum(n) - n)
        return ok

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids in each).

        Words of Latin small letters go straight to the library's model, other words of letters alone to the whole
        library as one line: such a word is one piece, and a piece's last id is the only one that ends a word. Where
        the ends don't add up (the library knows other letters), each word goes on its own.
        """
        texts = [w.decode() for w in words]
        plain = [k for k, t in enumerate(texts) if t.isascii() and t.isalpha() or _plain(t)] if self.straight else []
        others = sorted(set(range(len(texts))).difference(plain))
        line = [k for k in others if texts[k].isalpha() and unicodedata.is_normalized("NFC", texts[k])]
        flat, size, rest = [], np.zeros(len(texts), np.int64), set(others).difference(line)
        for some, encode in ((plain, self._by_model), (line, self._by_line)):
            if some:
                ids = np.array(encode(" ".join(texts[k] for k in some)), dtype=np.uint32)
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) == len(some) and ends[-1] == len(ids):
                    size[some] = np.diff(np.concatenate(([0], ends)))
                    flat.append((some, ids))
                else:
                    rest.update(some)
        if rest:
            some = sorted(rest)
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([texts[k] for k in some], add_special_tokens=False)]
            size[some] = [len(x) for x in lists]
            flat.append((some, list(itertools.chain.from_iterable(lists))))
        start = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint32)
        for some, ids in flat:
            out[bytesx.ragged(start[some], size[some])] = ids
        return out, size

    def _by_model(self, line: str) -> list[int]:
        signs = _SIGN[np.frombuffer(line.encode(), np.uint8)].tobytes().decode("utf-32-le")
        return [t.id for w in signs.split(" ") for t in self.model.tokenize(w)]

    def _by_line(self, line: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids

    def _learn(self, words: list[bytes], digests: np.ndarray, eight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers of new words, which ``_enter`` lets be found."""
        flat, count = self._encode(words)
        size = np.array([len(w) for w in words], np.int64)
        blocks, n = bytesx.blocks(eight, starts, size)
        numbers = np.arange(self.known, self.known + len(words))
        self.known += len(words)
        self.digest, self.size, self.block, self.start, self.count = (
            _grown(x, self.known) for x in (self.digest, self.size, self.block, self.start, self.count)
        )
        self.flat = _grown(self.flat, self.used + len(flat))
        self.blocks = _grown(self.blocks, self.filled + len(blocks))
        self.digest[numbers], self.size[numbers], self.count[numbers] = digests, size, count
        self.start[numbers] = self.used + np.cumsum(count) - count
        self.block[numbers] = self.filled + np.cumsum(n) - n
        self.flat[self.used : self.used + len(flat)] = flat
        self.blocks[self.filled : self.filled + len(blocks)] = blocks
        self.used += len(flat)
        self.filled += len(blocks)
        return numbers

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after another, ids in each), without end ids."""
        if not self.by_word:
            raw = data.tobytes()
            texts = [raw[i:j].decode() for i, j in itertools.pairwise(offsets.tolist())]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([x for ids in lists for x in ids], dtype=np.uint32), np.array([len(x) for x in lists], dtype=np.int64)
        data = bytesx.lower(data)  # the tokenizer lowers all letters itself
        starts, ends, counts = _pieces(data, offsets)
        if self.known > CACHE:
            self.forget()
        runs, size = bytesx.Runs(data), ends - starts
        digests = runs(starts, ends)
        first, back = _distinct(digests)
        # Words of one digest that are not one word go on their own.
        rep = first[back]
        same = size == size[rep]
        same[same] = runs.equal(starts[same], starts[rep[same]], size[same])
        odd = np.flatnonzero(~same)
        back[odd] = len(first) + np.arange(len(odd))
        number = np.concatenate((self._find(digests[first]), np.full(len(odd), -1)))
        found = number >= 0
        alone = np.arange(len(number)) >= len(first)
        first = np.concatenate((first, odd))
        alone[found] = ~self._equal(number[found], runs.eight, starts[first[found]], size[first[found]])
        new = np.flatnonzero(~found | alone)
        raw, at = data.tobytes(), first[new]
        words = [raw[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        for k in range(0, len(new), 4_096):
            mine = slice(k, k + 4_096)
            number[new[mine]] = self._learn(words[mine], digests[at[mine]], runs.eight, starts[at[mine]])
        while 2 * self.known > len(self.slots):
            old = np.sort(self.slots[self.slots >= 0])
            self.slots = np.full(2 * len(self.slots), -1, np.int32)
            self._enter(old)
        self._enter(number[new[~alone[new]]])
        word = number[back]
        many = self.count[word]
        ids = self.flat[bytesx.ragged(self.start[word], many)]
        total = np.concatenate(([0], np.cumsum(many)))
        at = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(total[at])


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _ended(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(sizes), end), sizes + 1


WRITTEN = "part int, seq int, n_ids long, doc_ids array<long>, blob binary"


def write_ids(
    spark: SparkSession, docs: DataFrame, tokenizer: str, *, partitions: int | None = None, end_id: int = END_ID,
    encoder: Callable[[str], WordEncoder] = _encoder,
):
    """Write the ids of every whole text in ascending doc_id order; returns the written table.

    Null text is the empty text and has the end id alone. Null ids come first; equal ids are
    ordered by their text's hash, so repeated rows lie together. An empty table gives an empty file.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = partitions or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: tuple[list, list, list] = ([], [], [])

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            ids, sizes = np.concatenate(held[0]), np.concatenate(held[1])
            out = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()),
                "doc_ids": pa.array([[x for c in held[2] for x in c]], pa.list_(pa.int64())), "blob": pa.array([pack(ids, sizes, enc.base)], pa.binary()),
            })
            seq, held = seq + 1, ([], [], [])
            return out

        for b in batches:
            names = b["doc_id"].to_pylist()
            for i, j, data, offsets in bytesx.slices(b["text"]):
                ids, sizes = _ended(*enc(data, offsets), end_id)
                for x, y in zip(held, (ids, sizes, names[i:j]), strict=True):
                    x.append(y)
                if sum(map(len, held[0])) >= SHARD_IDS:
                    yield flush()
        if held[0]:
            yield flush()

    return stash(spark, ordered.mapInArrow(run, WRITTEN), "ids")


def read_ids(written: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files' shards alone."""
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each written partition
    sums = written.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(parts), F.lit(0))).select("part", "base")
    at = (
        written.select("part", "seq", "n_ids")
        .withColumn("inner", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        .join(sums, "part")
        .select("part", "seq", (F.col("base") + F.col("inner")).cast("long").alias("start"))
    )

    def run(batches):
        import zlib

        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row["blob"])
                ids = shard.ids(0, shard.n).astype("<u4").tobytes()
                ends = np.cumsum(shard.sizes, dtype=np.int64)
                begins = ends - shard.sizes
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["start"]), pa.array(shard.sizes.astype(np.int64)),
                    pa.array([zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return written.join(at, ["part", "seq"]).select("doc_ids", "blob", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
