"""What substring operators share: anchored stretches, which of them may repeat, and their way back.

An operator cuts each document into stretches. A stretch is a run of consecutive window starts whose
windows choose the same anchor, and the choice depends on a window's content alone. So equal windows
have equal anchors at equal distances, and can be found by comparing stretches with one anchor name.
An occurrence is (name, body, rid, s0, n, times): the anchor's name and the digest of the whole stretch, both
64 bits and independent of each other, the row, the first window start, the number of starts, and how often the
stretch comes in a row (a periodic passage is one occurrence, however long).

Names that occur once are dropped by a count and a semi join, both keyed by name; copies of one
stretch are one class (name, body) from then on, by partial aggregation before any exchange.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.scratch import Stash, settled, small_batches, stash


def numbered(docs: DataFrame) -> DataFrame:
    """Rows with ``rid``, known by their place in the input, and the whole text; null text is empty."""
    small_batches(docs.sparkSession)
    return settled(docs.sparkSession, docs.select("doc_id", "text")).select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


NONE = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))


def collapsed(doc: np.ndarray, s0: np.ndarray, n: np.ndarray, name: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches with their ``times``: equal ones that follow one another in a document are one."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1]) | (body[1:] != body[:-1]) | (s0[1:] != s0[:-1] + n[:-1])
    first = np.flatnonzero(new)
    return *(x[first] for x in (doc, s0, n, name, body)), np.diff(np.concatenate((first, [len(doc)])))


def repeated(spark: SparkSession, found: DataFrame, label: str) -> Stash:
    """Occurrences whose name occurs at least twice, written."""
    everything = stash(spark, found, f"{label}-all")
    names = everything.df.groupBy("name").agg(F.sum("times").alias("all")).where("all > 1").select("name")
    kept = stash(spark, everything.df.join(names, "name", "left_semi"), f"{label}-repeated")
    everything.drop()
    return kept


def with_text(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows that ``wanted`` (rid, asked: a list bounded by the row's length) asks about, with their text."""
    return rows.select("rid", "text").join(wanted, "rid")
