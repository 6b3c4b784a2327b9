"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def _mark(df: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(df.agg(F.count(F.lit(1)), F.sum(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of longs to (u, root) for every node that has an edge; root: the smallest node.

    Each round is written to the shared folder, so that lineage stays short and lost executors cost a
    round at most. Minima are aggregated before they are joined back, so that a node with very many
    edges is a skewed join, which Spark splits, and never one group in one task. Edges with a null end, and of a
    node to itself, count for nothing; repeated edges count once; a table without edges gives no rows.
    """
    flip = F.col("u") < F.col("v")
    e = edges.filter("u <> v").select(
        F.when(flip, F.col("v")).otherwise(F.col("u")).alias("u"),
        F.when(flip, F.col("u")).otherwise(F.col("v")).alias("v"),
    )
    e = written(e.distinct(), "edges")
    before = _mark(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest)
        after = written(small.toDF("u", "v").distinct(), "edges")
        now = _mark(after)
        remove(e.sparkSession, e.scratch_path)
        e = after
        if now == before:
            return e.select("u", F.col("v").alias("root"))
        before = now
