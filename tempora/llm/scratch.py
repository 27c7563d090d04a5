"""Intermediate tables in the folder that driver and executors share.

A long plan is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it
back: any executor can read it again, so a lost executor costs no recomputation of what came
before. Where a local session (tests on one machine) names no folder, a temporary one is set; a
cluster must name one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_ROWS, BATCH_BYTES = 2_000, 4_000_000


def shared_root(spark: SparkSession) -> str:
    """The folder named by the cluster; one of our own only where the setting is missing."""
    root = spark.conf.get(_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{_SETTING} must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tempora-")
        spark.conf.set(_SETTING, root)
        _fs_path(spark, root, on_exit=True)
    return root.rstrip("/")


def _fs_path(spark: SparkSession, path: str, on_exit: bool = False):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if on_exit:
        fs.deleteOnExit(p)
    return fs, p


def _small_batches(spark: SparkSession) -> dict[str, str]:
    rows = int(spark.conf.get(_BATCH))
    return {_BATCH: str(min(BATCH_ROWS, rows) if rows > 0 else BATCH_ROWS), _BATCH_BYTES: str(BATCH_BYTES)}


def small_batches(spark: SparkSession) -> None:
    """For results that the caller's own action computes: from now on this session's rows reach Python few at a time."""
    for k, v in _small_batches(spark).items():
        spark.conf.set(k, v)


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores until none of ``columns`` has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def settled(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` if it only reads files, so that its rows have the same places whenever they are read; written otherwise."""
    plan = df._jdf.queryExecution().optimizedPlan()
    kinds = {line.lstrip(" +-:").split(" ", 1)[0] for line in plan.toString().splitlines()}
    if df.inputFiles() and plan.deterministic() and kinds <= {"Project", "Filter", "Relation"}:
        return df
    return Stash(spark, df, "input").df


def bundles(batches: Iterator[pa.RecordBatch], rows: int, size: int, column: str, place: str) -> Iterator[tuple[int, pa.Table]]:
    """A task's rows in order, in bundles that end with the ``rows``-th row or the one that fills ``size`` bytes of ``column``.

    A bundle is known by the ``place`` of its first row, whatever the batches, so another pass over the same files
    has the same bundles.
    """
    held: list[pa.RecordBatch] = []
    n = used = 0
    for b in batches:
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(b[column]), 0), np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = min(at + rows - n, int(np.searchsorted(ends, before + size - used)) + 1, b.num_rows)
            held.append(b.slice(at, end - at))
            n, used, at = n + end - at, used + int(ends[end - 1]) - before, end
            if n >= rows or used >= size:
                yield held[0][place][0].as_py(), pa.Table.from_batches(held)
                held, n, used = [], 0, 0
    if held:
        yield held[0][place][0].as_py(), pa.Table.from_batches(held)


class Stash:
    """A written table: ``df`` reads it, ``drop`` deletes it. It is deleted at exit at the latest."""

    def __init__(self, spark: SparkSession, df: DataFrame, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/tempora-{name}-{uuid.uuid4().hex[:12]}"
        schema = df.schema
        # This job's shuffle files go when the table is written; rows with long values reach Python few at a time.
        ours = {_CLEANUP: "true", **_small_batches(spark)}
        before = {k: spark.conf.get(k) for k in ours}
        try:
            for k, v in ours.items():
                spark.conf.set(k, v)
            df.write.parquet(self.path)
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        _fs_path(spark, self.path, on_exit=True)
        self.df = spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        fs, p = _fs_path(self.spark, self.path)
        fs.delete(p, True)


def stash(spark: SparkSession, df: DataFrame, name: str) -> Stash:
    return Stash(spark, df, name)
