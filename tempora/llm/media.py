"""Media columns with content-defined chunks that are stored once.

A payload becomes a media object (here: 8-bit mono PCM in a WAV container, one sample a byte).
Media bytes are cut where a rolling gear hash has zeros in its top bits, so equal stretches are
cut alike wherever they lie. Chunk digests are gathered by Spark joins: the first occurrence of a
digest owns the bytes, all others refer to it. The store has three kinds of rows:

* packs: the chunks of media that share none, many to a compressed row, with each chunk's digest and size
  and the ordered chunk list of each of these media;
* chunks: a digest and its compressed bytes, for media that share a chunk with anything else;
* entries: the ordered chunk list of such media, one row for each place.

Every object is read by its chunk list: from its pack, or by a join of entries to chunks by digest. The bytes
are put together in order, and every pack's chunk and every object is verified against the digest that was written;
a mismatch stops the read.

Nothing is collected to the driver, and bytes move once to be stored and, for shared media only,
once more to be read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.scratch import bundles, settled, small_batches, stash

#: Chunk sizes in bytes: a cut needs CUT_BITS zero bits, after at least LEAST and at most MOST bytes.
LEAST, CUT_BITS, MOST = 512, 11, 8_192
WINDOW = 32
#: Rows of a bundle, and bytes of text that end one.
BUNDLE, BUNDLE_BYTES = 250, 4_000_000
LEVEL = 6
UNIT = 192
RATE = 16_000

_GEAR = np.random.default_rng(0x6EA7).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + G[byte i] modulo 2^32 at every byte, by doubling: it reaches back 32 bytes."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h = h + shifted
        width *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of one object; none for an empty one."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    found = np.flatnonzero(gear(np.frombuffer(data, np.uint8)) >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, at, k = [], 0, 0
    while at < n:
        k = int(np.searchsorted(found, at + LEAST, side="left"))
        end = min(int(found[k]) if k < len(found) else n, at + MOST, n)
        out.append(end)
        at = end
    return out


def wav(payload: bytes) -> bytes:
    """A WAV file of 8-bit mono samples."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def samples(media: bytes) -> bytes:
    """The samples of such a file; anything else is an error."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data" or len(media) != 44 + struct.unpack("<I", media[40:44])[0]:
        raise ValueError("not a WAV file as this module writes it")
    return media[44:]


def padded(body: bytes) -> bytes:
    """``body`` with spaces up to a positive multiple of UNIT bytes."""
    return body + b" " * (max(1, -(-len(body) // UNIT)) * UNIT - len(body))


def describe(payload: bytes) -> str:
    """Mean, deviation, range and sign changes of the samples, as whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    above = x >= 128
    return f"n={len(x)};sum={int(x.sum())};sq={int((x * x).sum())};min={int(x.min())};max={int(x.max())};cross={int((above[1:] != above[:-1]).sum())}"


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _to_media(body: bytes | None) -> tuple[int, bytes]:
    raw = body or b""
    return len(raw), wav(padded(raw))


def store(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """Write the media of every row's text; returns the written table (kind 0 packs, 1 chunks, 2 entries).

    Null text is the empty text; null, repeated and clashing ids are kept as they are, a row is known
    by its place in the input. An empty table gives an empty store.
    """
    rid = F.monotonically_increasing_id()
    rows = settled(spark, docs.select(id_col, text_col)).select(rid.alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))

    def digests(batches):
        for bundle, t in bundles(batches, BUNDLE, BUNDLE_BYTES, "body", "rid"):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for r, body in zip(t["rid"].to_pylist(), t["body"], strict=True):
                _, media = _to_media(body.as_py())
                at = 0
                for k, end in enumerate(cuts(media)):
                    for o, x in zip(out, (bundle, r, k, digest(media[at:end])), strict=True):
                        o.append(x)
                    at = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["bundle", "rid", "idx", "digest"]
            )

    found = rows.select("rid", "body").mapInArrow(digests, "bundle long, rid long, idx int, digest binary")
    seen = stash(spark, found, "digests")
    owner = seen.df.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("rid", "idx")).alias("own")).where("n > 1")
    shared = (
        seen.df.join(owner, "digest")
        .groupBy("bundle")
        .agg(F.collect_list(F.struct("rid", "idx", (F.struct("rid", "idx") == F.col("own")).alias("owns"))).alias("shared"))
    )  # a bundle has BUNDLE rows or BUNDLE_BYTES, which bounds its list

    def pack(batches):
        z = zstandard.ZstdCompressor(level=LEVEL)
        for bundle, t in bundles(batches, BUNDLE, BUNDLE_BYTES, "body", "rid"):
            ids, names, bodies = t["rid"].to_pylist(), t["doc_id"].to_pylist(), t["body"].to_pylist()
            sizes = [len(x or b"") for x in bodies]
            yield pa.RecordBatch.from_pydict({
                "bundle": pa.array([bundle], pa.int64()), "rids": pa.array([ids], pa.list_(pa.int64())), "doc_ids": pa.array([names], pa.list_(pa.int64())),
                "sizes": pa.array([sizes], pa.list_(pa.int64())), "z": pa.array([z.compress(b"".join(x or b"" for x in bodies))], pa.binary()),
            })

    packed = rows.mapInArrow(pack, "bundle long, rids array<long>, doc_ids array<long>, sizes array<long>, z binary")

    def write(batches):
        z, back = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for b in batches:
            for row in b.to_pylist():
                marks: dict[int, dict[int, bool]] = {}
                for s in row["shared"] or ():
                    marks.setdefault(s["rid"], {})[s["idx"]] = s["owns"]
                blob, at = back.decompress(row["z"], max_output_size=max(1, sum(row["sizes"]))), 0
                out: list[dict] = []
                chunks: list[bytes] = []
                lists: list[dict] = []
                for r, name, size in zip(row["rids"], row["doc_ids"], row["sizes"], strict=True):
                    n, media = _to_media(blob[at : at + size])
                    at += size
                    whole = hashlib.sha256(media).digest()
                    own = marks.get(r)
                    if own is None:
                        ends = cuts(media)
                        lists.append({"rid": r, "doc_id": name, "n_bytes": n, "sha": whole, "chunks": range(len(chunks), len(chunks) + len(ends))})
                        chunks += [media[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
                        continue
                    start = 0
                    for k, end in enumerate(cuts(media)):
                        d = digest(media[start:end])
                        out.append({"kind": 2, "rid": r, "doc_id": name, "n_bytes": n, "sha": whole, "idx": k, "digest": d})
                        if own.get(k, True):
                            out.append({"kind": 1, "digest": d, "bytes": z.compress(media[start:end])})
                        start = end
                if chunks:
                    out.append({
                        "kind": 0, "rid": row["bundle"], "digest": b"".join(map(digest, chunks)), "sizes": list(map(len, chunks)),
                        "bytes": z.compress(b"".join(chunks)), "list": lists,
                    })
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    stored = packed.join(shared, "bundle", "left").mapInArrow(write, STORE)
    table = stash(spark, stored, "media")
    seen.drop()
    return table


STORE = (
    "kind int, rid long, doc_id long, n_bytes long, sha binary, idx int, digest binary, bytes binary, "
    "sizes array<int>, list array<struct<rid:long,doc_id:long,n_bytes:long,sha:binary,chunks:array<int>>>"
)
_ARROW = pa.schema([
    ("kind", pa.int32()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("idx", pa.int32()),
    ("digest", pa.binary()), ("bytes", pa.binary()), ("sizes", pa.list_(pa.int32())),
    ("list", pa.list_(pa.struct([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("chunks", pa.list_(pa.int32()))]))),
])

READ = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, n_chunks int"
)


def _facts(name, n: int, media: bytes, sha: bytes, chunks: int) -> dict:
    import zlib

    if hashlib.sha256(media).digest() != sha:
        raise ValueError(f"the stored media of {name} differ from what was written")
    payload = samples(media)
    return {
        "doc_id": name, "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(media), "media_sha256": sha.hex(), "feature": describe(payload), "n_chunks": chunks,
    }


_READ = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_chunks", pa.int32()),
])


def read(stored: DataFrame, facts: Callable[..., dict] = _facts) -> DataFrame:
    """One row for each stored object, with what ``facts`` says of the verified bytes."""

    small_batches(stored.sparkSession)

    def packs(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for row in b.to_pylist():
                blob, at, chunks, out = z.decompress(row["bytes"], max_output_size=max(1, sum(row["sizes"]))), 0, [], []
                for size in row["sizes"]:
                    chunks.append(blob[at : at + size])
                    at += size
                if b"".join(map(digest, chunks)) != row["digest"]:
                    raise ValueError(f"chunks of pack {row['rid']} differ from what was written")
                for e in row["list"]:
                    out.append(facts(e["doc_id"], e["n_bytes"], b"".join(chunks[k] for k in e["chunks"]), e["sha"], len(e["chunks"])))
                yield pa.RecordBatch.from_pylist(out, schema=_READ)

    def joined(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for row in b.to_pylist():
                parts = sorted(row["parts"], key=lambda p: p["idx"])
                media = b"".join(z.decompress(p["bytes"], max_output_size=MOST) for p in parts)
                out.append(facts(row["doc_id"], row["n_bytes"], media, row["sha"], len(parts)))
            yield pa.RecordBatch.from_pylist(out, schema=_READ)

    alone = stored.where("kind = 0").select("rid", "digest", "bytes", "sizes", "list").mapInArrow(packs, READ)
    entries = stored.where("kind = 2").select("rid", "doc_id", "n_bytes", "sha", "idx", "digest")
    chunks = stored.where("kind = 1").select("digest", "bytes")
    media = entries.join(chunks, "digest").groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.first("sha").alias("sha"), F.collect_list(F.struct("idx", "bytes")).alias("parts")
    )
    return alone.unionByName(media.mapInArrow(joined, READ))
