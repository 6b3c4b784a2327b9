"""Preference formatting: prompts rendered once, paired completions with masks.

Turns are ordered by (turn, role, hash of the text), nulls first; a turn that a conversation has several times
counts as often. The prompt of a pair is the longest common prefix of its chosen and its rejected conversation;
a conversation's completion is all that follows. Both are sorted, so that the first difference is the smallest
turn that they don't have equally often: one aggregate over turns without their texts finds it.

Rendering: ``<|role|>\\ntext<|end|>\\n``; an assistant's turns in completions are trained, all others are context
and masked. Two forms:

* format_pairs: a row a pair: prompt, chosen, rejected, and for each completion the character ranges to train. A part
  of more than TURNS turns goes on in further rows of the pair (block 1, 2, ...), so that no conversation, however
  long, is ever gathered in one place; the rows' texts in order of block are the whole.
* format_preferences: a row for every turn rendered (a segment).

Turns are placed without their texts (plans.registers.numbered); a text is moved once to meet its place and once to
its row.

Defined results: without a pair table conversations 2 n and 2 n + 1 are pair n's chosen and rejected (n is rounded
down, also below zero); a null id belongs to no pair and its turns are left out, a null role renders as ``unknown``,
a null text as nothing; a pair with one conversation only has an empty prompt and paired false; two equal
conversations are all prompt; a conversation of several pairs is rendered for each; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registers import numbered
from .common import prepare, table

TURNS = 64
PARTS = ("prompt", "chosen", "rejected")


def render(role: Column, text: Column) -> Column:
    return F.concat(
        F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n")
    )


def _sided(turns: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """pair_id, c (of the chosen conversation), turn, role, text, h (the text's hash), k (hash of all three)."""
    own = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text").filter("conv_id IS NOT NULL")
    h = F.md5(F.col("text").cast("binary"))
    own = own.withColumn("h", h).withColumn("k", F.md5(F.to_json(F.struct("turn", "role", "h")).cast("binary")))
    if pairs is None:
        half, side = F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(F.lit(1).cast("bigint")) == 0
        return own.select(half.alias("pair_id"), side.alias("c"), "turn", "role", "text", "h", "k")
    sides = F.explode(F.array(F.struct(F.lit(True).alias("c"), F.col("chosen_id").alias("id")), F.struct(F.lit(False).alias("c"), F.col("rejected_id").alias("id"))))
    ids = pairs.select("pair_id", sides.alias("x")).select("pair_id", "x.c", F.col("x.id").cast("bigint").alias("conv_id"))
    return own.join(ids, "conv_id").select("pair_id", "c", "turn", "role", "text", "h", "k")


def _copies(n: Column) -> Column:
    """0 to n - 1 as rows, in two steps, so that very many copies are no array."""
    step = F.lit(1 << 12).cast("bigint")
    return F.sequence(F.lit(0).cast("bigint"), n - 1, step)


def _placed(sided: DataFrame) -> DataFrame:
    """pair_id, paired, part, i (the place in the part), turn, role, k: a row for each turn to render, without texts."""
    each = sided.groupBy("pair_id", "turn", "role", "h", "k").agg(F.count_if("c").alias("nc"), F.count_if(~F.col("c")).alias("nr"))
    place = F.struct(F.col("turn").isNotNull(), "turn", F.col("role").isNotNull(), "role", F.col("h").isNotNull(), "h")
    first = each.groupBy("pair_id").agg(
        F.min(F.when(F.col("nc") != F.col("nr"), place)).alias("first"), ((F.sum("nc") > 0) & (F.sum("nr") > 0)).alias("paired")
    )
    marked = each.join(first, "pair_id")
    # Before the first difference all copies are common, at it as many as both have, and none behind it.
    common = F.when(F.col("first").isNull() | (place <= F.col("first")), F.least("nc", "nr")).otherwise(0)
    parts = F.array(*[F.struct(F.lit(p).alias("part"), n.cast("bigint").alias("n")) for p, n in zip(PARTS, (common, F.col("nc") - common, F.col("nr") - common), strict=True)])
    rows = marked.withColumn("x", F.explode(F.filter(parts, lambda x: x["n"] > 0))).withColumn("a", F.explode(_copies(F.col("x.n"))))
    rows = rows.withColumn("copy", F.explode(F.sequence("a", F.least(F.col("x.n"), F.col("a") + (1 << 12)) - 1)))
    rows = rows.select("pair_id", "paired", F.col("x.part").alias("part"), "turn", "role", "h", "k", "copy")
    nulls = [F.asc_nulls_first(c) for c in ("turn", "role", "h")]
    rows = numbered(rows, "pair_id", "part", *nulls, "copy", name="_n")
    starts = rows.groupBy("pair_id", "part").agg(F.min("_n").alias("_s"))
    return rows.join(starts, ["pair_id", "part"]).select("pair_id", "paired", "part", (F.col("_n") - F.col("_s")).alias("i"), "turn", "role", "k")


def _segments(turns: DataFrame, pairs: DataFrame | None) -> DataFrame:
    sided = _sided(turns, pairs)
    texts = sided.groupBy("pair_id", "k").agg(F.first("text").alias("text"))
    train = (F.col("part") != "prompt") & F.coalesce(F.col("role") == "assistant", F.lit(False))
    joined = _placed(sided).join(texts, ["pair_id", "k"])
    return joined.select("pair_id", "paired", "part", "i", "turn", "role", render(F.col("role"), F.col("text")).alias("segment"), train.alias("train"))


def format_preferences(turns: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """turns: conv_id, turn, role, text. pairs: pair_id, chosen_id, rejected_id.

    pair_id, paired, part (prompt, chosen, rejected), i (from 0, the order within the part), turn, role, segment, train."""
    return _segments(turns, pairs)


def format_pairs(turns: DataFrame, pairs: DataFrame | None = None, turns_a_row: int = TURNS) -> DataFrame:
    """pair_id, block, paired, prompt, chosen, rejected (text), chosen_train, rejected_train (arrays of start, end:
    characters of the row's completion, end excluded)."""
    rows = _segments(turns, pairs).withColumn("block", F.floor(F.col("i") / turns_a_row))
    got = rows.groupBy("pair_id", "block").agg(
        F.first("paired").alias("paired"),
        *[F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("i", "segment", "train")))).alias(f"_{p}") for p in PARTS],
    )
    text = lambda p: F.array_join(F.transform(f"_{p}", lambda x: x["segment"]), "").alias(p)

    def ranges(p: str) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            end = s["at"] + F.length(x["segment"])
            more = F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), end.alias("end"))))
            return F.struct(end.alias("at"), F.when(x["train"], more).otherwise(s["out"]).alias("out"))

        return F.aggregate(f"_{p}", zero, step)["out"].alias(f"{p}_train")

    return got.select("pair_id", "block", "paired", *[text(p) for p in PARTS], ranges("chosen"), ranges("rejected"))


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = format_pairs(table(spark, sf_dir, "conversations"))
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",").alias(c)
    return out.select("pair_id", "block", "paired", *PARTS, flat("chosen_train"), flat("rejected_train"))


ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, turn, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos,
    a.pos IS NOT NULL AND b.pos IS NOT NULL AND a.turn IS NOT DISTINCT FROM b.turn
      AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.pos = b.pos
), d AS (
  SELECT pair_id, coalesce(min(pos) FILTER (WHERE NOT same), 1 << 40) AS first FROM k GROUP BY pair_id
), s AS (
  SELECT t.pair_id, CASE WHEN pos < first THEN 'prompt' WHEN side = 0 THEN 'chosen' ELSE 'rejected' END AS part,
    CASE WHEN pos < first THEN pos - 1 ELSE pos - first END AS i, side,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS segment,
    pos >= first AND coalesce(role = 'assistant', false) AS train
  FROM t JOIN d USING (pair_id) WHERE pos >= first OR side = 0
), m AS (
  SELECT *, i // {TURNS} AS block, sum(length(segment)) OVER (PARTITION BY pair_id, part, i // {TURNS} ORDER BY i) AS z FROM s
), p AS (SELECT pair_id, count(DISTINCT side) = 2 AS paired FROM t GROUP BY pair_id)
SELECT pair_id, CAST(block AS BIGINT) AS block, any_value(paired) AS paired,
  coalesce(string_agg(segment, '' ORDER BY i) FILTER (WHERE part = 'prompt'), '') AS prompt,
  coalesce(string_agg(segment, '' ORDER BY i) FILTER (WHERE part = 'chosen'), '') AS chosen,
  coalesce(string_agg(segment, '' ORDER BY i) FILTER (WHERE part = 'rejected'), '') AS rejected,
  coalesce(string_agg((z - length(segment)) || '-' || z, ',' ORDER BY i) FILTER (WHERE part = 'chosen' AND train), '') AS chosen_train,
  coalesce(string_agg((z - length(segment)) || '-' || z, ',' ORDER BY i) FILTER (WHERE part = 'rejected' AND train), '') AS rejected_train
FROM m JOIN p USING (pair_id) GROUP BY pair_id, block
"""
