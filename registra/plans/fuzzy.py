"""Candidate pairs for edit-distance joins, without loss and without a nested loop.

A string of length n is cut into k + 1 segments, k being the most edits that a partner may be away. A
partner has at least one of them unchanged, at most k places from its own place. So strings meet by an
equi-join on (length, segment number, segment), which Spark shuffles or broadcasts by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _most(n: Column, ratio: float) -> Column:
    """Most edits between a string of length n and any partner that is within ratio of the longer one."""
    return F.floor(F.floor(n / (1 - ratio)) * ratio).cast("int")


def _start(n: Column, k: Column, i: Column) -> Column:
    return F.floor(n * i / (k + 1)).cast("int")


def near_pairs(left: DataFrame, right: DataFrame, ratio: float) -> DataFrame:
    """left (l, s) and right (r, t), strings under distinct keys: all (l, r) with an edit distance of at most
    ratio times the longer length, and some others."""
    n = F.length("t")
    r = right.filter(n > 0).withColumn("n", n).withColumn("k", _most(F.col("n"), ratio))
    cut = F.transform(
        F.sequence(F.lit(0), F.col("k")),
        lambda i: F.struct(
            i.alias("i"),
            F.substring("t", _start(F.col("n"), F.col("k"), i) + 1, _start(F.col("n"), F.col("k"), i + 1) - _start(F.col("n"), F.col("k"), i)).alias("part"),
        ),
    )
    r = r.select("r", "n", F.explode(cut).alias("x")).select("r", "n", "x.i", "x.part")
    m = F.length("s")
    lengths = F.sequence(F.ceil(m * (1 - ratio) - 1e-9).cast("int"), F.floor(m / (1 - ratio) + 1e-9).cast("int"))
    q = left.filter(m > 0).select("l", "s", m.alias("m"), F.explode(lengths).alias("n"))
    q = q.withColumn("k", _most(F.col("n"), ratio)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    a = _start(F.col("n"), F.col("k"), F.col("i"))
    q = q.withColumn("a", a).withColumn("w", _start(F.col("n"), F.col("k"), F.col("i") + 1) - a)
    low, high = F.greatest(F.lit(0), F.col("a") - F.col("k")), F.least(F.col("m") - F.col("w"), F.col("a") + F.col("k"))
    q = q.filter(low <= high).withColumn("at", F.explode(F.sequence(low, high)))
    q = q.select("l", "n", "i", F.substring("s", F.col("at") + 1, F.col("w")).alias("part")).distinct()
    return q.join(r, ["n", "i", "part"]).select("l", "r").distinct()
