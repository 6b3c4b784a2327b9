"""Usage events: counters, retention, bursts, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The closed vocabulary of counters in these tables.
COUNTERS = ("click", "error", "purchase", "signup", "view")


def daily(events: DataFrame) -> DataFrame:
    """day, name, n."""
    known = events.filter(F.col("name").isin(*COUNTERS))
    return known.groupBy(F.to_date("ts").alias("day"), "name").agg(F.count(F.lit(1)).alias("n"))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(100.0 * part / whole + 0.5).cast("bigint"))


def hit_rates(events: DataFrame, hit: str, base: str) -> DataFrame:
    """day, base, hit, rate (percent, half up)."""
    n = lambda x: F.count_if(F.col("name") == x)
    days = events.groupBy(F.to_date("ts").alias("day")).agg(n(base).alias("base"), n(hit).alias("hit"))
    return days.withColumn("rate", rate(F.col("hit"), F.col("base")))


def activity(events: DataFrame, names: tuple[str, ...], days: int = 14) -> DataFrame:
    """The last days with entries: day, n, share of the largest."""
    per = events.filter(F.col("name").isin(*names)).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    last = per.orderBy(F.desc("day")).limit(days)
    top = last.agg(F.max("n").alias("top"))
    return last.join(F.broadcast(top)).select("day", "n", (F.col("n") / F.col("top")).alias("share"))


def retained(events: DataFrame, days: int = 30) -> DataFrame:
    """Events of the newest `days` days that have entries. The list of days is at most `days` rows."""
    kept = events.select(F.to_date("ts").alias("day")).distinct().orderBy(F.desc("day")).limit(days)
    return events.join(kept, F.to_date("ts") == F.col("day"), "left_semi")


def newest(rows: DataFrame, at: str, tie: str, k: int) -> DataFrame:
    """A bounded history: the newest k rows (TakeOrderedAndProject, no global sort)."""
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(k)


def bursts(events: DataFrame, name: str, per: str, least: int, window_ms: int) -> DataFrame:
    """Events of a name that are at least the `least`th within the trailing window (its start excluded)."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(per).orderBy("ms").rangeBetween(-(window_ms - 1), 0)
    rows = events.filter(F.col("name") == name).withColumn("ms", ms)
    return rows.withColumn("recent", F.count(F.lit(1)).over(w)).filter(F.col("recent") >= least).drop("ms")


def graded(reads: DataFrame) -> DataFrame:
    """Grade of each read: HANG with an error, ACCEPT with identifiers, REJECT with text, else EMPTY."""
    grade = (
        F.when(F.coalesce("error", F.lit("")) != "", "HANG").when(F.size("cas") > 0, "ACCEPT")
        .when(F.coalesce("raw", F.lit("")) != "", "REJECT").otherwise("EMPTY")
    )
    return reads.withColumn("grade", grade)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def run_summary(reads: DataFrame) -> DataFrame:
    """One row for a run (reads: grade, ms, passes): reads, accept, reject, empty, hang, mean_ms, max_ms, mean_passes."""
    n = lambda g: F.count_if(F.col("grade") == g)
    return reads.agg(
        F.count(F.lit(1)).alias("reads"), n("ACCEPT").alias("accept"), n("REJECT").alias("reject"), n("EMPTY").alias("empty"), n("HANG").alias("hang"),
        F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"), F.avg("passes").alias("mean_passes"),
    )


def run_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """n, before, after (grades), delta (percent by which the time changed, half up) of the reads (n, grade, ms) of two runs;
    a read that only one run has is listed with nulls."""
    a = before.select("n", F.col("grade").alias("before"), F.col("ms").alias("_a"))
    b = after.select("n", F.col("grade").alias("after"), F.col("ms").alias("_b"))
    delta = F.when(F.col("_a") > 0, F.floor(100.0 * (F.col("_b") - F.col("_a")) / F.col("_a") + 0.5).cast("bigint"))
    return a.join(b, "n", "full").select("n", "before", "after", delta.alias("delta"))
