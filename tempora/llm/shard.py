"""Uniform sharding with exact shard sizes, in DataFrame functions only.

A uniform random shuffle of n rows into k shards, each shard one row larger than another at
most, is drawn in three steps:

1. Rows are cut into ``parts`` source parts by a hash of their content. For each part the exact
   numbers of its rows that go to each shard are drawn from the multivariate hypergeometric
   law, which is the law these counts have under a uniform permutation (the communication
   matrix). Its row sums are the part sizes and its column sums the shard sizes.
2. Each part permutes its rows locally by a seeded hash; the first c1 go to shard 0, the next
   c2 to shard 1, and so on. This is the one exchange that moves rows.
3. Each shard permutes what it received, by a second seeded hash, and numbers it from 0.

No step needs a whole shard in one task: slots are numbered in cells of a shard, whose number
grows with the rows, each with an offset. Equal rows fall into different parts and cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm.scratch import settled

SHARDS = 24
ROWS_PER_PART = 2_000
MAX_PARTS = 4_096  # bounds the matrix on the driver and the broadcast plan (98,304 rows at most); parts grow beyond it
CELL_ROWS = 2_000
SEED = 20_240_517


def communication_matrix(parts: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Counts[part, shard], drawn so that a uniform permutation would give them.

    Parts take their rows in turn from what is left of each shard's capacity. Empty input
    gives an empty matrix; parts of no rows give rows of zeros.
    """
    total = int(sum(parts))
    left = np.full(shards, total // shards, dtype=np.int64)
    left[: total % shards] += 1
    rng = np.random.default_rng(seed)
    out = np.zeros((len(parts), shards), dtype=np.int64)
    for i, n in enumerate(parts):
        out[i] = rng.multivariate_hypergeometric(left, n, method="marginals") if n else 0
        left -= out[i]
    return out


def _order(*cols: Column | str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def shard_rows(
    spark: SparkSession,
    rows: DataFrame,
    key: list[str],
    shards: int = SHARDS,
    seed: int = SEED,
    rows_per_part: int = ROWS_PER_PART,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``key`` names the columns that tell rows apart. Rows that agree in all of them are copies
    of one another: they get different slots, and which copy gets which is immaterial, so that
    a repeated task gives the same table. Null keys are values like any other. An empty table
    gives an empty table. Columns named shard or slot are replaced, others may have any names.
    """
    others = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    rows = settled(spark, rows).select(F.struct("*").alias("_row"))
    key = [f"_row.`{k}`" for k in key]
    n = rows.count()
    parts = min(MAX_PARTS, max(1, -(-n // rows_per_part)))
    # Copies of one row hash alike; a salt that counts them would need an exchange, so parts
    # of equal rows are split by a random number drawn from the row's place in its own input.
    dealt = rows.withColumn("_pos", F.monotonically_increasing_id()).withColumn(
        "_part", F.pmod(_order(*key, "_pos", seed=seed), F.lit(parts)).cast("int")
    )
    sizes = dict(dealt.groupBy("_part").count().collect())  # one row for each part
    matrix = communication_matrix([sizes.get(i, 0) for i in range(parts)], shards, seed)
    ends = np.cumsum(matrix, axis=1)
    lines = [
        (i, j, int(ends[i, j] - matrix[i, j]), int(ends[i, j]))
        for i in range(parts)
        for j in range(shards)
        if matrix[i, j]
    ]
    plan = spark.createDataFrame(lines, "_part int, shard int, _from long, _to long")

    local = Window.partitionBy("_part").orderBy(_order(*key, "_pos", seed=seed + 1), *key, "_pos")
    placed = (
        dealt.withColumn("_rank", F.row_number().over(local) - F.lit(1))
        .join(F.broadcast(plan), ["_part"])
        .where("_rank >= _from and _rank < _to")
        .drop("_part", "_rank", "_from", "_to")
    )

    cells = max(1, -(-n // (shards * cell_rows)))
    mixed = placed.withColumn("_at", _order(*key, "_pos", seed=seed + 2)).withColumn(
        "_cell", F.pmod(F.shiftright("_at", 20), F.lit(cells)).cast("int")
    )
    offsets = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        mixed.groupBy("shard", "_cell")
        .count()
        .withColumn("_start", F.coalesce(F.sum("count").over(offsets), F.lit(0)))
        .drop("count")
    )
    within = Window.partitionBy("shard", "_cell").orderBy("_at", *key, "_pos")
    return (
        mixed.withColumn("_n", F.row_number().over(within) - F.lit(1))
        .join(starts, ["shard", "_cell"])
        .withColumn("slot", (F.col("_start") + F.col("_n")).cast("long"))
        .select(*[F.col(f"_row.`{c}`") for c in others], "shard", "slot")
    )
