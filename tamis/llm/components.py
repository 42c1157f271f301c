"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join; each round is written to the shared folder, so
lineage stays short.  The driver sees counts and one checksum, never edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import shared


def _large(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(F.broadcast(least) if few else least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(edges: DataFrame, few: bool) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(F.broadcast(least) if few else least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, component) for every node that has an edge and is not its component's least; and the folders in use.

    ``edges``: columns a and b of one ordered type.  Loops, repeated and reversed edges do no harm."""
    made = [shared.scratch(spark, "edges")]
    now = shared.table(spark, edges.select("a", "b").where("a != b").distinct(), made[0])
    count, seal = now.count(), None
    while True:
        # The minima of few edges are sent to every task, so the centre of a star is no one's burden.
        few = 4 * count <= shared.MOST_BROADCAST
        made.append(shared.scratch(spark, "edges"))
        now = shared.table(spark, _small(_large(now, few), few), made[-1])
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        shared.drop(spark, made.pop(0))
        if tuple(new) == seal:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")), made
        count, seal = new[0], tuple(new)
