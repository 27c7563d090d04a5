"""Connected components of an edge table by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.scratch import Stash, stash


def components(spark: SparkSession, edges: DataFrame) -> Stash:
    """(node, root): the least node that is reachable, for every node that has an edge.

    ``edges`` has long columns a and b. Each round joins every node to its least neighbour, if that
    is less than itself, and contracts; the number of nodes at least halves where edges remain. Loops and
    repeated edges do no harm, null ends are left out.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    left = stash(spark, both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = left.df.select(F.col("a").alias("node")).union(left.df.select("b")).distinct()
    roots = stash(spark, nodes.select("node", F.col("node").alias("root")), "roots")
    while not left.df.isEmpty():
        parent = left.df.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        up = stash(spark, parent, "parents")
        moved = roots.df.join(up.df.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        fresh = stash(spark, moved, "roots")
        pa, pb = (up.df.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        lifted = left.df.join(pa, "a", "left").join(pb, "b", "left").select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"))
        rest = stash(spark, lifted.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        for t in (left, roots, up):
            t.drop()
        left, roots = rest, fresh
    left.drop()
    return roots
