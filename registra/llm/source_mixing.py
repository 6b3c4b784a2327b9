"""Mix sources to target weights: Sainte-Lague apportionment of equal-token blocks.

1. Sizes: a document's words. A source's target is its weight's share of all words, at most ``most`` times
   the source's own words; what is above goes to the others by weight until none is above.
2. A source's documents are dealt by hash into shards of about ``shard_words`` words, and each shard's
   words, in order of (id, text hash), are cut into blocks of ``block`` words (the last may be shorter).
3. All blocks that the targets come to are seats: highest quotients target / (2 s + 1) give seats to
   sources, highest quotients words / (2 s + 1) hand a source's seats on to its groups of shards (GROUPS at
   most) and a group's to its shards, none beyond ``most`` times its blocks. So a source of any size is handed
   out in one small table of groups and many tables of shards.
4. In a shard with q seats and n blocks every block is taken q div n times; the q mod n blocks that a
   seeded affine permutation of the block numbers puts first are taken once more.

Only one row a source reaches the driver, for SOURCES sources at most: more are refused, as they are no sources
to weigh one by one (hosts, say, have to be gathered into sources first). Nothing depends on partitioning.

Defined results: null and empty texts have size 0 and take 0; a null source is a source of its own and
the last by order; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, written

SEED = 20_240_607
MOST = 3
SHARD_WORDS = 262_144
GROUPS = 1_024
SOURCES = 1_000_000
#: Blocks have a 131,072nd of all words, between 1 and 1,024.
BLOCKS, LARGEST_BLOCK = 131_072, 1_024


def capped_targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST) -> list[float]:
    """Shares of sum(sizes) by weight, none above most * its size, the excess shared by weight again."""
    total, free, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
            free.discard(i)
    return out


def sainte_lague(votes: Sequence[float], seats: int, limits: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1), ties to the earlier; limits: most seats of each.

    Every rounding of votes / d is a state that the method passes through; so it starts from the one for a
    d that gives away too few seats, and deals out the rest one by one.
    """
    limits = limits or [seats] * len(votes)
    got = [0] * len(votes)
    if sum(votes) > 0:
        d = sum(votes) / max(seats, 1)
        while True:
            got = [min(m, math.floor(v / d + 0.5)) for v, m in zip(votes, limits, strict=True)]
            if sum(got) <= seats:
                break
            d *= 1 + 1 / (2 * max(seats, 1)) + 1e-9 + (sum(got) - seats) / max(seats, 1) / 2
    queue = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if v > 0 and g < limits[i]]
    heapq.heapify(queue)
    for _ in range(seats - sum(got)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < limits[i]:
            heapq.heappush(queue, (-votes[i] / (2 * got[i] + 1), i))
    return got


def sized(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, source, size, h (the text's hash, for order among repeated ids) and extra columns."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", "source", F.regexp_count(t, F.lit(WORD)).cast("bigint").alias("size"), F.xxhash64(t).alias("h"), *extra
    )


def plan(docs: DataFrame, sizes: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (with size and h) and source_size, target, pieces: array of (start, words, times), the runs of
    the document's words that belong to one block each, with how often the mix takes them."""
    spark = docs.sparkSession
    found = sizes.groupBy("source").agg(F.sum("size").alias("size")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    sources = [(x.source, x.size) for x in found]
    sources.sort(key=lambda x: (x[0] is None, x[0] or ""))  # str order is code point order
    weights = [1 + i % 3 for i in range(len(sources))]
    targets = capped_targets([n for _, n in sources], weights)
    total = sum(n for _, n in sources)
    block = min(LARGEST_BLOCK, max(1, total // BLOCKS))
    seats = sainte_lague(targets, math.ceil(total / block))
    rows = [
        (s, n, t, g, max(1, -(-n // SHARD_WORDS)))
        for (s, n), t, g in zip(sources, targets, seats, strict=True)
    ]
    about = spark.createDataFrame(rows, "source string, source_size long, target double, seats long, shards long")
    about = about.withColumnRenamed("source", "s_")

    def with_shard(df: DataFrame) -> DataFrame:
        df = df.join(about, F.col("source").eqNullSafe(F.col("s_")), "left").drop("s_")
        return df.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h"), F.col("shards")))

    group = F.pmod("shard", F.lit(GROUPS))
    by_shard = with_shard(sizes).groupBy("source", group.alias("group"), "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats"))
    by_shard = written(by_shard.withColumn("blocks", F.ceil(F.col("words") / F.lit(block))), "shards")

    def apportioned(pdf, key):
        """The rows' shares of the seats that the first of them names."""
        pdf = pdf.sort_values(key)
        q = sainte_lague([int(w) for w in pdf.words], int(pdf.seats.iloc[0]), [MOST * int(x) for x in pdf.blocks])
        return pdf.assign(q=q)

    def quotas(pdf):
        import random

        pdf = apportioned(pdf, "shard")
        steps, shifts = [], []
        for k, x in zip(pdf.shard, map(int, pdf.blocks), strict=True):
            rng = random.Random(f"{seed}/{pdf.source.iloc[0]}/{k}")
            a = rng.randrange(1, x + 1) if x else 1
            while x and math.gcd(a, x) != 1:
                a = rng.randrange(1, x + 1)
            steps.append(a)
            shifts.append(rng.randrange(x) if x else 0)
        return pdf.assign(a=steps, b=shifts)[["source", "shard", "blocks", "q", "a", "b"]]

    by_group = by_shard.groupBy("source", "group").agg(F.sum("words").alias("words"), F.first("seats").alias("seats"), F.sum("blocks").alias("blocks"))
    handed = by_group.groupBy("source").applyInPandas(
        lambda pdf: apportioned(pdf, "group")[["source", "group", "q"]], "source string, group long, q long"
    )
    handed = handed.select(F.col("source").alias("s_"), F.col("group").alias("g_"), F.col("q").alias("seats"))
    shards = by_shard.drop("seats").join(handed, F.col("source").eqNullSafe(F.col("s_")) & (F.col("group") == F.col("g_"))).drop("s_", "g_")
    quota = shards.groupBy("source", "group").applyInPandas(
        quotas, "source string, shard long, blocks long, q long, a long, b long"
    )
    quota = quota.select(
        F.col("source").alias("s_"), F.col("shard").alias("k_"), F.col("blocks").alias("n_"), F.col("q").alias("q_"),
        F.col("a").alias("a_"), F.col("b").alias("b_"),
    )
    within = Window.partitionBy("source", "shard").orderBy(F.col("doc_id").asc_nulls_first(), "h", "size")
    df = with_shard(docs).withColumn("end_", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("from_", F.col("end_") - F.col("size"))
    df = df.join(quota, F.col("source").eqNullSafe(F.col("s_")) & (F.col("shard") == F.col("k_")), "left")
    size = F.lit(block).cast("bigint")
    first, last = F.floor(F.col("from_") / size), F.floor((F.col("end_") - 1) / size)

    def piece(i):
        start, end = F.greatest(F.col("from_"), i * size), F.least(F.col("end_"), (i + 1) * size)
        turn = F.pmod(F.col("a_") * i + F.col("b_"), F.col("n_"))
        times = F.floor(F.col("q_") / F.col("n_")) + F.when(turn < F.pmod("q_", "n_"), 1).otherwise(0)
        return F.struct(
            (start - F.col("from_")).alias("start"), (end - start).alias("words"), times.cast("bigint").alias("times")
        )

    pieces = F.when(F.col("size") > 0, F.transform(F.sequence(first, last), piece))
    df = df.withColumn("pieces", F.coalesce(pieces, F.array().cast("array<struct<start:bigint,words:bigint,times:bigint>>")))
    return df.drop("s_", "k_", "n_", "q_", "a_", "b_", "end_", "from_", "seats", "shards", "shard")


def taken() -> Column:
    return F.aggregate("pieces", F.lit(0).cast("bigint"), lambda a, x: a + x["words"] * x["times"])


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: documents' columns, a row for each of a document's rounds (1 to 3) in which some of
    its words are taken, with those words as text; n_chars, if there, follows the text."""
    columns = docs.columns
    rest = [c for c in columns if c not in ("doc_id", "source")]
    sizes = written(sized(docs), "mix")
    df = plan(sized(docs, *rest), sizes)
    df = df.withColumn("round_", F.explode(F.sequence(F.lit(1), F.lit(MOST))))
    whole = F.forall("pieces", lambda x: x["times"] >= F.col("round_"))
    df = df.withColumn("_some", F.exists("pieces", lambda x: x["times"] >= F.col("round_"))).filter("_some")
    parts = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    df = df.withColumn("_whole", whole).withColumn("_parts", F.when(~F.col("_whole"), parts))
    cut = F.transform(
        F.filter("pieces", lambda x: x["times"] >= F.col("round_")),
        lambda x: F.array_join(F.slice("_parts", (x["start"] + 1).cast("int"), x["words"].cast("int")), ""),
    )
    df = df.withColumn("text", F.when(F.col("_whole"), F.col("text")).otherwise(F.array_join(cut, "")))
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.length("text").cast("bigint"))
    return df.select(*columns)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import prepare, table

    prepare(spark)
    sizes = written(sized(table(spark, sf_dir, "documents")), "sizes")
    return plan(sizes, sizes).select("doc_id", "size", "source_size", "target", taken().alias("taken"), "source")
