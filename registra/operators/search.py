"""Batch search of queries over a register: exact, identifier and fuzzy branches, ranked per query.

register: row_id, source_key, row, name, cas (and whatever else); queries: qid, q. A row's score is that of
its name, then of its cell of identifiers, each rule in turn replacing the rounded best by a larger raw value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.text import js_round
from ..plans.fuzzy import near_pairs
from ..plans.shared import written

MIN_SCORE = 80
LIMITS = {"farmer": 16, "pro": 80}
#: Sources by priority; others rank 99.
RANK = {"libya-248": 0, "libya-500": 1, "eu": 2, "epa": 3, "epa-cancelled": 4}
MERGE_RANK = {k: v for k, v in RANK.items() if k != "epa-cancelled"}


def rank_of(key: Column, ranks: dict[str, int] = RANK) -> Column:
    out = F.lit(99)
    for k, v in reversed(ranks.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def indexed(register: DataFrame) -> DataFrame:
    """The register with its search keys."""
    keyed = register.withColumn("nname", F.when(F.coalesce("name", F.lit("")) != "", T.norm(F.col("name"))))
    keyed = keyed.withColumn("ncas", F.when(F.coalesce("cas", F.lit("")) != "", T.norm(F.col("cas"))))
    return (
        keyed.withColumn("cname", T.compact(F.col("nname")))
        .withColumn("ccas", T.compact(F.col("ncas")))
        .withColumn("numbers", T.cas_numbers(F.col("cas")))
    )


def _asked(queries: DataFrame) -> DataFrame:
    q = F.coalesce(F.col("q"), F.lit(""))
    keyed = queries.select("qid", q.alias("q"), T.norm(q).alias("nq"), T.is_cas(q).alias("by_cas"))
    return keyed.withColumn("cq", T.compact(F.col("nq")))


def _facts(nq: Column, cq: Column, n: Column, c: Column) -> Column:
    """What the rules need of a query's and a text's keys: equal, partial (raw score of containment, or null), similar
    (raw score by edits, or null); null for a null text."""
    a, b = F.length(nq), F.length(n)
    ratio = F.least(a, b) / F.greatest(a, b, F.lit(1))
    inside = (a >= 4) & (b >= 4) & (ratio >= 0.72) & (F.contains(n, nq) | F.contains(nq, n))
    longest = F.greatest(F.length(cq), F.length(c))
    similar = 100 - F.levenshtein(cq, c) / F.greatest(longest, F.lit(1)) * 100
    facts = F.struct((nq == n).alias("equal"), F.when(inside, ratio * 96).alias("partial"), F.when(longest > 0, similar).alias("similar"))
    return F.when(n.isNotNull(), facts)


def _score(name: Column, cell: Column) -> Column:
    """struct<v, type, field> from the facts of a row's name and of its cell of identifiers: the rules in order, each
    replacing the rounded best by a larger raw value. A text that is no pair's has null facts: all its raw values
    would round to less than the cut."""
    rule = lambda raw, kind, field: F.struct(raw.cast("double").alias("raw"), F.lit(kind).alias("type"), F.lit(field).alias("field"))
    rules = F.array(
        rule(F.when(name["equal"], 1000), "name", "name"),
        rule(name["partial"], "partial", "name"), rule(name["similar"], "similar", "name"),
        rule(F.when(cell["equal"], 100), "name", "cas"),
        rule(cell["partial"], "partial", "cas"), rule(cell["similar"], "similar", "cas"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("v"), F.lit("").alias("type"), F.lit("").alias("field"))
    better = lambda s, r: F.struct(js_round(r["raw"]).alias("v"), r["type"].alias("type"), r["field"].alias("field"))
    return F.aggregate(rules, start, lambda s, r: F.when(F.coalesce(r["raw"] > s["v"], F.lit(False)), better(s, r)).otherwise(s))


def hits(queries: DataFrame, register: DataFrame, no_cas: tuple[str, ...] = ()) -> DataFrame:
    """qid, register's columns, v, type (cas, name, partial, similar), field, decisive, candidate.

    A query shaped as an identifier finds rows that list identifiers by equality alone. All others are
    compared by distinct text: equal keys, and pairs from two lossless blockings, one for edits over
    compact keys, one for containment. no_cas: sources without identifiers, where all but an equal name is
    a candidate. The keyed register, its distinct texts and the pairs' facts are written, as several joins read each."""
    rows, asked = written(indexed(register), "keyed"), _asked(queries)
    columns = register.columns
    wanted = asked.filter("by_cas").select("qid", F.trim("q").alias("number"))
    found = rows.withColumn("number", F.explode(F.array_distinct("numbers"))).join(wanted, "number")
    by_cas = found.select(
        "qid", *columns, F.lit(100).cast("bigint").alias("v"), F.lit("cas").alias("type"), F.col("number").alias("field"),
        F.lit(False).alias("decisive"),
    )
    texts = rows.select(F.explode(F.array(F.struct(F.col("nname").alias("n"), F.col("cname").alias("c")), F.struct(F.col("ncas").alias("n"), F.col("ccas").alias("c")))).alias("x"))
    texts = written(texts.select("x.*").filter("n IS NOT NULL").distinct(), "texts")
    q = asked.select("qid", "by_cas", "nq", "cq")
    compacts = near_pairs(q.select(F.col("cq").alias("l"), F.col("cq").alias("s")).distinct(),
                          texts.select(F.col("c").alias("r"), F.col("c").alias("t")).distinct(), 0.205)
    norms = near_pairs(q.select(F.col("nq").alias("l"), F.col("nq").alias("s")).distinct(),
                       texts.select(F.col("n").alias("r"), F.col("n").alias("t")), 1 - 79.5 / 96)
    own = ["qid", "by_cas", "nq", "cq", "n", "c"]
    pairs = (
        q.join(compacts, q.cq == compacts.l).join(texts, F.col("r") == F.col("c")).select(own)
        .union(q.join(norms, q.nq == norms.l).join(texts, F.col("r") == F.col("n")).select(own))
        .union(q.join(texts, q.nq == texts.n).select(own))
        .distinct()
    )
    # The edit distance of two texts is computed once, however many rows have them.
    compared = _facts(*[F.col(x) for x in ("nq", "cq", "n", "c")])
    facts = written(pairs.select("qid", "by_cas", "n", compared.alias("x")), "facts")
    keyed = rows.select("row_id", "nname", "ncas", (F.size("numbers") > 0).alias("numbered"))
    side = lambda key, kind: facts.join(keyed.filter(F.col(key).isNotNull()), F.col("n") == F.col(key)).filter("not (by_cas and numbered)").select(
        "qid", "row_id", F.lit(kind).alias("kind"), "x"
    )
    by_row = side("nname", "name").union(side("ncas", "cas")).groupBy("qid", "row_id").agg(
        F.max(F.when(F.col("kind") == "name", F.col("x"))).alias("_name"), F.max(F.when(F.col("kind") == "cas", F.col("x"))).alias("_cas")
    )
    scored = by_row.withColumn("s", _score(F.col("_name"), F.col("_cas"))).filter(F.col("s.v") >= MIN_SCORE)
    exact = F.coalesce(F.col("_name.equal"), F.lit(False))
    fuzzy = scored.select("qid", "row_id", F.least("s.v", F.lit(100)).alias("v"), "s.type", F.col("s.field").alias("_field"), exact.alias("decisive"))
    field = F.when(F.col("_field") == "cas", F.col("cas")).otherwise(F.col("name"))
    fuzzy = fuzzy.join(rows, "row_id").select("qid", *columns, "v", "type", field.alias("field"), "decisive")
    flag = F.col("source_key").isin(*no_cas) & ~F.col("decisive") & (F.col("type") != "cas") if no_cas else F.lit(False)
    return by_cas.unionByName(fuzzy).withColumn("candidate", flag)


DIRECT = 1_000


def direct_scores(queries: DataFrame, register: DataFrame) -> DataFrame:
    """qid, row_id, v, type: every row's score of at least MIN_SCORE by the rules themselves, without any index: what the
    indexed search is checked against. The queries, at most DIRECT, are written into the plan, so that each row meets
    each of them in a map. Only a cell that is one plain identifier is compared as an identifier here."""
    asked = queries.select("qid", "q").limit(DIRECT + 1).collect()
    if len(asked) > DIRECT:
        raise ValueError(f"more than {DIRECT} queries")
    if not asked:
        asked_as = F.array().cast("array<struct<qid:bigint,q:string>>")
    else:
        asked_as = F.array(*[F.struct(F.lit(x.qid).cast("bigint").alias("qid"), F.lit(x.q or "").alias("q")) for x in asked])
    rows = indexed(register).withColumn("_a", F.explode(asked_as)).select("*", "_a.qid", F.col("_a.q").alias("q"))
    nq = T.norm(F.col("q"))
    rows = rows.withColumn("_nq", nq).withColumn("_cq", T.compact(F.col("_nq")))
    fact = lambda n, c: _facts(F.col("_nq"), F.col("_cq"), F.col(n), F.col(c))
    scored = rows.withColumn("_s", _score(fact("nname", "cname"), fact("ncas", "ccas")))
    both = T.is_cas(F.col("q")) & T.is_cas(F.col("cas"))
    same = F.trim("q") == F.trim("cas")
    v = F.when(both, F.when(same, 100).otherwise(0)).otherwise(F.least("_s.v", F.lit(100)))
    out = scored.select("qid", "row_id", v.cast("bigint").alias("v"), F.when(both, "cas").otherwise(F.col("_s.type")).alias("type"))
    return out.filter(F.col("v") >= MIN_SCORE)


def ranked(found: DataFrame, k: int, ranks: dict[str, int] = RANK) -> DataFrame:
    """The first k hits of each query by source priority, score, source order and row order."""
    order = Window.partitionBy("qid").orderBy(
        rank_of(F.col("source_key"), ranks), F.desc("v"), "source_ordinal", "row_id"
    )
    return found.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)


def merged(found: DataFrame, k: int = 24) -> DataFrame:
    """Hits of many queries of one batch, the best per row (the earlier query on ties), then the first k."""
    row = F.struct(*[F.col(f"`{c}`") for c in found.columns])
    once = found.groupBy(F.col("batch").alias("_b"), F.col("row_id").alias("_r")).agg(F.min_by(row, F.struct(-F.col("v"), "qid")).alias("_x")).select("_x.*")
    order = Window.partitionBy("batch").orderBy(
        rank_of(F.col("source_key"), MERGE_RANK), F.desc("v"), "source_ordinal", "row_id"
    )
    return once.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)


def available(register: DataFrame, states: DataFrame) -> DataFrame:
    """register without the sources that states (source_key, state, rows) doesn't call ready, or calls empty."""
    ready = states.filter("state = 'ready' and coalesce(rows, 1) > 0").select("source_key").distinct()
    return register.join(ready, "source_key", "left_semi")


def totals(states: DataFrame) -> DataFrame:
    """One row: sources, ready (sources), rows (of ready ones)."""
    return states.agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(F.col("state") == "ready").alias("ready"),
        F.coalesce(F.sum(F.when(F.col("state") == "ready", F.col("rows"))), F.lit(0)).cast("bigint").alias("rows"),
    )


def candidate_hits(reads: DataFrame, register: DataFrame, mode: str, no_cas: tuple[str, ...] = ()) -> DataFrame:
    """Hits of what reads (read_id, cas array, names array) hold: the expert mode searches identifiers, the plain mode
    name candidates; read_id, via (what was searched) and hits' columns. Equal strings are searched once."""
    asked = reads.select("read_id", F.explode("cas" if mode == "pro" else "names").alias("via")).distinct()
    once = asked.select("via").distinct().select(F.xxhash64("via").alias("qid"), F.col("via").alias("q"))
    once = once.groupBy("qid", "q").agg(F.lit(1)).select("qid", "q")
    return asked.withColumn("qid", F.xxhash64("via")).join(hits(once, register, no_cas), "qid")


def search_candidates(reads: DataFrame, register: DataFrame, mode: str, no_cas: tuple[str, ...] = (), k: int = 24) -> DataFrame:
    """A read's merged result: the best hit per row over all that was searched for it, then the first k."""
    return merged(candidate_hits(reads, register, mode, no_cas).withColumn("batch", F.col("read_id")), k)


def read_scores(reads: DataFrame, register: DataFrame) -> DataFrame:
    """read_id, best, exact_name, exact_cas, name: what the register says of each read (read_id, cas, names): the best
    score, whether a name or an identifier is met exactly, and the best hit's name (the first by score, row)."""
    each = candidate_hits(reads, register, "pro").unionByName(candidate_hits(reads, register, "farmer"))
    scored = each.groupBy("read_id").agg(
        F.max("v").alias("best"), F.bool_or("decisive").alias("exact_name"), F.bool_or(F.col("type") == "cas").alias("exact_cas"),
        F.min_by("name", F.struct(-F.col("v"), "row_id")).alias("name"),
    )
    no = F.lit(False)
    return reads.select("read_id").join(scored, "read_id", "left").select(
        "read_id", F.coalesce("best", F.lit(0)).alias("best"), F.coalesce("exact_name", no).alias("exact_name"),
        F.coalesce("exact_cas", no).alias("exact_cas"), "name",
    )


def report(found: DataFrame, k: int | None = None) -> DataFrame:
    """Hits as a report lists them: by falling score, then row; the first k if given."""
    out = found.orderBy(F.desc("v"), "qid", "row_id")
    return out if k is None else out.limit(k)
