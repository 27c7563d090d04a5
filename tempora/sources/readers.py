"""Readers of files that timelines come from, and sinks with guards."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from tempora.functions import exprs

# Text of the placeholder transcript, in order.
PLACEHOLDERS = ("placeholder speech one", "placeholder speech two", "placeholder speech three")


def keyframe_dir(spark: SparkSession, path: str) -> DataFrame:
    """(t, path, content) of the pictures whose name states a time, in order of t and name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path)
    return files.withColumn("t", exprs.file_time(F.col("path"))).where("t is not null").select("t", "path", "content").orderBy("t", "path")


def index_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The five tables of an aligned-output document."""
    doc = spark.read.option("multiLine", True).json(path)
    out = {}
    for name in ("asr", "ocr", "attention_windows", "keyframes", "motion_segments"):
        if name in doc.columns:
            out[name] = doc.select(F.explode(name).alias("x")).select("x.*")
    if "asr" in out and "hallucination" in out["asr"].columns:
        out["asr"] = out["asr"].where(~F.coalesce("hallucination", F.lit(False)))
    if "ocr" in out:
        out["ocr"] = out["ocr"].where("trim(text) <> ''")
    return out


def frame_times(spark: SparkSession, path: str) -> DataFrame:
    """Times from third-party lists: bare numbers or objects, in a list or under ``frames``; other entries go."""
    text = spark.read.text(path, wholetext=True)
    v = F.try_parse_json("value")
    items = F.coalesce(F.try_variant_get(v, "$.frames", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    return text.select(F.explode(items).alias("v")).select(exprs.tolerant_time(F.col("v")).alias("t")).where("t is not null")


def representatives(spark: SparkSession, path: str) -> DataFrame:
    """(t, path) of representatives, a list or under that key, in order of time; one without a time is an error."""
    v = F.parse_json("value")
    items = F.coalesce(F.try_variant_get(v, "$.representatives", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    each = spark.read.text(path, wholetext=True).select(F.explode(items).alias("v"))
    t = F.coalesce(F.try_variant_get("v", "$.t", "double"), F.raise_error(F.lit("a representative has no time")).cast("double"))
    return each.select(t.alias("t"), F.try_variant_get("v", "$.path", "string").alias("path")).orderBy("t", "path")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(start_s, end_s, desc) of annotated scenes in order of start; an annotation without scenes is an error."""
    found = F.from_json("value", "scenes array<struct<start_s:double,end_s:double,desc:string>>")["scenes"]
    none = F.raise_error(F.lit("the annotation has no scenes")).cast("array<struct<start_s:double,end_s:double,desc:string>>")
    scenes = spark.read.text(path, wholetext=True).select(F.inline(F.when(F.size(found) > 0, found).otherwise(none)))
    return scenes.orderBy("start_s", "end_s")


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of files, to check them against what they should be."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def subtitles(aligned: DataFrame, asr: DataFrame) -> DataFrame:
    """Aligned segments, or the transcript with two-second ends where there are none; empty text goes."""
    a = aligned.where("trim(text) <> ''").select("video_id", F.col("start_t").alias("t"), "end_t", "text")
    rest = asr.where("trim(text) <> ''").select("video_id", "t", F.coalesce("end_t", F.col("t") + 2.0).alias("end_t"), "text")
    return a.unionByName(rest.join(a.select("video_id").distinct(), "video_id", "left_anti"))


def decode_wav(raw: bytes, rate: int = 16_000) -> np.ndarray:
    """The first channel as floats in [-1, 1), resampled linearly."""
    with wave.open(io.BytesIO(raw)) as w:
        width, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
        data = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    else:
        x = np.frombuffer(data, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / 2.0 ** (8 * width - 1)
    x = x.reshape(-1, channels)[:, 0].astype(np.float32)
    if own == rate or not len(x):
        return x
    n = int(round(len(x) * rate / own))
    return np.interp(np.arange(n) * own / rate, np.arange(len(x)), x).astype(np.float32)


def audio_chunks(spark: SparkSession, path: str, seconds: float = 2.0, rate: int = 16_000) -> DataFrame:
    """(path, chunk, t, samples: float32 bytes) of WAV files in blocks of fixed length, the last one as it is."""
    step = int(seconds * rate)

    def run(batches):
        for pdf in batches:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                x = decode_wav(c, rate)
                rows += [(p, k, k * seconds, x[k * step : (k + 1) * step].tobytes()) for k in range(-(-len(x) // step))]
            yield pd.DataFrame(rows, columns=["path", "chunk", "t", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, chunk int, t double, samples binary")


def mock_transcript(spark: SparkSession, duration: float, window: float = 15.0) -> DataFrame:
    n = int(np.ceil(duration / window))
    texts = F.array(*[F.lit(x) for x in PLACEHOLDERS])
    return spark.range(n).select((F.col("id") * window).alias("t"), F.element_at(texts, (F.col("id") % len(PLACEHOLDERS) + 1).cast("int")).alias("text"))


class _Span(InputPartition):
    def __init__(self, video: int, start: int, end: int):
        self.video, self.start, self.end = video, start, end


class FrameSource(DataSource):
    """Synthetic frames, format ``frames``: options videos, frames, fps, height, width, speed, live.

    A batch read is partitioned by (video, frame range), with time frame / fps (0.02 s a frame if fps is 0).
    As a stream it is paced: each trigger delivers what is due since the query began, at ``speed``; with
    ``live`` only the newest frame that is due (one-slot mailbox), and ``dropped`` counts those passed over.
    """

    PART = 64

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "video_id long, seq long, t double, h int, w int, image binary, dropped long"

    def _options(self) -> dict:
        o = self.options
        kind = o.get("kind", "file")
        if kind not in ("file", "cam", "rtsp"):
            raise ValueError(f"unknown source kind {kind!r}")
        if kind != "file" and o.get("synthetic", "false") != "true":
            raise ValueError(f"no {kind} backend is built in; synthetic=true gives test pictures in its place")
        return {
            "videos": int(o.get("videos", 1)), "frames": int(o.get("frames", 90)), "fps": float(o.get("fps", 30)), "h": int(o.get("height", 24)), "w": int(o.get("width", 32)),
            "speed": float(o.get("speed", 1)), "live": kind != "file" or o.get("live", "false") == "true",
        }

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _FrameReader(self._options())

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        return _PacedReader(self._options())


def synthetic_frame(video: int, k: int, h: int, w: int) -> bytes:
    """A flat picture with a bright square that moves during the middle third of each 90 frames."""
    x = np.full((h, w, 3), 40 + 20 * (video % 3), np.uint8)
    at = min(max(k % 90 - 30, 0), 30)
    x[h // 3 : h // 3 + 6, at % (w - 6) : at % (w - 6) + 6] = 220
    return x.tobytes()


class _FrameReader(DataSourceReader):
    def __init__(self, o: dict):
        self.o = o

    def partitions(self) -> list[_Span]:
        step = FrameSource.PART
        return [_Span(v, k, min(k + step, self.o["frames"])) for v in range(self.o["videos"]) for k in range(0, self.o["frames"], step)]

    def read(self, part: _Span):
        o = self.o
        for k in range(part.start, part.end):
            yield part.video, k, k / o["fps"] if o["fps"] else k * 0.02, o["h"], o["w"], synthetic_frame(part.video, k, o["h"], o["w"]), 0


class _PacedReader(SimpleDataSourceStreamReader):
    def __init__(self, o: dict):
        import time

        self.o, self.clock = o, time.monotonic
        self.began = None

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def read(self, start: dict):
        o = self.o
        self.began = self.began if self.began is not None else self.clock()
        due = min(o["frames"], int((self.clock() - self.began) * (o["fps"] or 25) * o["speed"]) + 1)
        first = start["frame"]
        due = max(due, first)
        take = range(max(first, due - 1), due) if o["live"] else range(first, due)
        rows = [(v, k, k / (o["fps"] or 25), o["h"], o["w"], synthetic_frame(v, k, o["h"], o["w"]), k - first if o["live"] else 0) for k in take for v in range(o["videos"])]
        return iter(rows), {"frame": due}

    def readBetweenOffsets(self, start: dict, end: dict):
        o = self.o
        take = range(max(start["frame"], end["frame"] - 1), end["frame"]) if o["live"] else range(start["frame"], end["frame"])
        return iter([(v, k, k / (o["fps"] or 25), o["h"], o["w"], synthetic_frame(v, k, o["h"], o["w"]), k - start["frame"] if o["live"] else 0) for k in take for v in range(o["videos"])])

    def commit(self, end: dict) -> None:
        return None


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write below a path that no ``..`` leaves; the table appears when it is whole."""
    if ".." in path.replace("\\", "/").split("/"):
        raise ValueError(f"path leaves its folder: {path}")
    df.write.mode(mode).json(path)


def markdown(rows: DataFrame, line: str = "line") -> DataFrame:
    """One text for each timeline: its lines in order of time."""
    ordered = F.array_sort(F.collect_list(F.struct("t", "seq", F.col(line).alias("line"))))
    return rows.groupBy("video_id").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("text"))


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON table for each artefact, such as events, aligned segments or evidence packs."""
    for name, df in tables.items():
        write_json(df, f"{path}/{name}")


def call_host(stream: DataFrame, f: Callable[[int, Iterator], None], checkpoint: str, columns: list[str]):
    """A writer that hands each batch's rows, in order of (t, seq), to a callback on the driver, in blocks of one partition."""

    def put(batch: DataFrame, k: int) -> None:
        f(k, batch.select(columns).orderBy("t", "seq").toLocalIterator(prefetchPartitions=False))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
