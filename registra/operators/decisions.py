"""The decision layer over hits: verdicts, ambiguity, collapse, context, match kinds, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..plans.fuzzy import near_pairs
from ..plans.shared import written

#: The sources that the plain mode shows.
HOME = ("libya-248", "libya-500")
BAN = "libya-248"


def first_cas(c: Column) -> Column:
    return F.trim(F.element_at(F.split(F.coalesce(c, F.lit("")), r"[\n\[\]]"), 1))


def verdicts(queries: DataFrame, register: DataFrame, found: DataFrame) -> DataFrame:
    """qid, source_key, row_id, verdict, level: of each name query the rows that the index has under its very name (a
    line or the head of one), which are exact, and those that the search found (found: qid, row_id), each judged by
    the best of its lines. Queries that are identifiers have no name verdicts (cas_verdict)."""
    lines = register.select("row_id", "source_key", F.explode(F.split("name", r"\n+")).alias("raw"))
    lines = lines.select("row_id", "source_key", T.verdict_key(F.col("raw")).alias("key"), T.head_name(F.col("raw")).alias("head"))
    number = F.get(T.parse_cas_cell(F.col("q")), F.lit(0))["cas"]
    q = queries.select("qid", T.verdict_key(F.col("q")).alias("qk"), F.replace(number, F.lit("-"), F.lit("")).alias("_d"))
    q = q.filter("qk <> ''").filter(F.col("_d").isNull() | (F.col("_d") != F.regexp_replace("qk", "[^0-9]", ""))).drop("_d")
    keys = lines.select("row_id", "source_key", F.explode(F.array_distinct(F.array("key", "head"))).alias("qk")).filter("qk <> ''")
    exact = q.join(keys, "qk").select("qid", "source_key", "row_id", F.lit("exact").alias("verdict"))
    hit = found.select("qid", "row_id").distinct().join(q, "qid").join(lines, "row_id")
    judged = hit.select("qid", "source_key", "row_id", T.judge_name(F.col("qk"), F.col("key")).alias("verdict")).filter("verdict IS NOT NULL")
    level = F.when(F.col("verdict") == "exact", 3).when(F.col("verdict") == "probable", 2).otherwise(1)
    best = judged.union(exact).groupBy("qid", "source_key", "row_id").agg(F.max(level).alias("level"))
    names = F.element_at(F.array(F.lit("similar"), F.lit("probable"), F.lit("exact")), F.col("level"))
    return best.select("qid", "source_key", "row_id", names.alias("verdict"), "level")


def per_source(judged: DataFrame, register: DataFrame) -> DataFrame:
    """qid, source_key, verdict, entries, ambiguous: more than one first identifier, and more than one entry
    at the deciding level (exact if there are any, else probable)."""
    cell = F.get(T.parse_cas_cell(F.col("cas")), F.lit(0))["cas"]
    rows = judged.join(register.select("row_id", cell.alias("c")), "row_id")
    out = rows.groupBy("qid", "source_key").agg(
        F.max("level").alias("level"), F.count(F.lit(1)).alias("entries"), F.countDistinct("c").alias("kinds"),
        F.count_if(F.col("level") == 3).alias("exacts"), F.count_if(F.col("level") == 2).alias("probables"),
    )
    deciding = F.when(F.col("exacts") > 0, F.col("exacts")).otherwise(F.col("probables"))
    verdict = F.element_at(F.array(F.lit("similar"), F.lit("probable"), F.lit("exact")), F.col("level"))
    return out.select("qid", "source_key", verdict.alias("verdict"), "entries", ((F.col("kinds") > 1) & (deciding > 1)).alias("ambiguous"))


def cas_verdict(queries: DataFrame, register: DataFrame) -> DataFrame:
    """qid, cas, source_key, row_id, verdict: exact only if both check digits hold."""
    stored = register.select("source_key", "row_id", F.explode(T.parse_cas_cell(F.col("cas"))).alias("x"))
    q = queries.select("qid", F.get(T.parse_cas_cell(F.col("q")), F.lit(0)).alias("a"))
    both = q.join(stored, F.col("a.cas") == F.col("x.cas"))
    sure = F.coalesce(F.col("a.checksum_ok") & F.col("x.checksum_ok"), F.lit(False))
    return both.select("qid", F.col("a.cas").alias("cas"), "source_key", "row_id", F.when(sure, "exact").otherwise("probable").alias("verdict")).distinct()


def ambiguity(found: DataFrame) -> DataFrame:
    """qid, leader, first, second, tier: the first two hits (by score, then order) of different rows and
    different identifiers, less than 8 points apart; with a leader at 100 one of them is the leader."""
    sig = F.array_join(T.cas_numbers(F.col("cas")), ",")
    order = Window.partitionBy("qid").orderBy(F.desc("v"), "pos")
    s = found.select("qid", "row_id", "v", "pos", sig.alias("sig")).withColumn("i", F.row_number().over(order))
    s = s.withColumn("top", F.max("v").over(Window.partitionBy("qid")))
    a, b = s.alias("a"), s.alias("b")
    pairs = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.i") < F.col("b.i")))
    pairs = pairs.filter(
        (F.col("a.row_id") != F.col("b.row_id")) & (F.col("a.sig") != F.col("b.sig")) & (F.col("a.v") - F.col("b.v") < 8)
        & ((F.col("a.top") < 100) | (F.col("a.i") == 1))
    )
    first = pairs.groupBy(F.col("a.qid").alias("qid")).agg(
        F.min_by(F.struct(F.col("a.row_id").alias("first"), F.col("b.row_id").alias("second")), F.struct(F.col("a.i"), F.col("b.i"))).alias("p")
    )
    tiers = s.groupBy("qid").agg(
        F.count_if(F.col("top") - F.col("v") < 8).alias("tier"), F.min_by("row_id", "i").alias("leader")
    )
    return first.join(tiers, "qid").select("qid", "leader", "p.first", "p.second", "tier")


def identity(kind: Column, field: Column, cas: Column, name: Column) -> Column:
    first = first_cas(cas)
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " "))
    return (
        F.when(F.trim(field).rlike(T.CAS), F.concat(F.lit("cas:"), F.trim(field)))
        .when((kind == "cas") & first.rlike(T.CAS), F.concat(F.lit("cas:"), first))
        .otherwise(F.concat(F.lit("name:"), plain))
    )


def collapse_same_source(found: DataFrame) -> DataFrame:
    """One hit per (query, source, identity), the best by score, then row, unless statuses or regulatory
    codes differ; merged_cas lists the first identifiers of the collapsed hits in order, if several."""
    df = found.withColumn("_id", identity(F.col("type"), F.col("field"), F.col("cas"), F.col("name")))
    key = ["qid", "source_key", "_id"]
    code = F.trim(F.coalesce(F.col("pc_code").cast("string"), F.lit("")))
    groups = df.groupBy(*key).agg(
        F.countDistinct(F.trim(F.coalesce("status", F.lit("")))).alias("_statuses"),
        F.countDistinct(F.when(code != "", code)).alias("_codes"),
        F.array_distinct(
            F.filter(
                F.transform(F.array_sort(F.collect_list(F.struct("pos", first_cas(F.col("cas")).alias("c")))), lambda x: x["c"]),
                lambda c: c != "",
            )
        ).alias("_cas"),
        F.min("pos").alias("first_pos"),
    )
    best = Window.partitionBy(*key).orderBy(F.desc("v"), "row")
    whole = (F.col("_statuses") > 1) | (F.col("_codes") > 1)
    out = df.withColumn("_n", F.row_number().over(best)).join(groups, key).filter(whole | (F.col("_n") == 1))
    several = ~whole & (F.size("_cas") > 1)
    return out.withColumn("merged_cas", F.when(several, F.array_join("_cas", ","))).drop("_id", "_n", "_statuses", "_codes", "_cas")


def collapse_to_decisive(found: DataFrame) -> DataFrame:
    """Where a query has a decisive hit: the hits of decisive substances, and those of reads whose words
    aren't all inside one decisive read; then collapse_same_source. Other queries' hits stay as they are."""
    words = F.filter(F.split(F.lower(F.coalesce("via", F.lit(""))), r"[^a-z0-9؀-ۿ]+"), lambda w: w != "")
    substance = F.concat_ws("|", F.lower(F.trim(F.coalesce("name", F.lit("")))), F.trim(F.coalesce("cas", F.lit(""))))
    df = found.withColumn("_words", words).withColumn("_what", substance)
    sure = df.filter("decisive").groupBy("qid").agg(
        F.collect_set("_what").alias("_whats"), F.collect_set(F.when(F.coalesce("via", F.lit("")) != "", F.col("_words"))).alias("_reads")
    )
    df = df.join(sure, "qid", "left")
    same = (F.size("_words") == 0) | F.exists("_reads", lambda r: F.size(F.array_except("_words", r)) == 0)
    kept = df.filter(F.col("_whats").isNull() | F.array_contains("_whats", F.col("_what")) | ~same)
    plain = kept.filter("_whats IS NULL").drop("_words", "_what", "_whats", "_reads")
    decided = collapse_same_source(kept.filter("_whats IS NOT NULL").drop("_words", "_what", "_whats", "_reads"))
    return decided.unionByName(plain, allowMissingColumns=True)


def in_context(found: DataFrame, mode: str, picked: str | None = None) -> DataFrame:
    """After top-k: the plain mode shows the picked source or the home sources; the expert mode shows all,
    the picked source first (place)."""
    if mode != "pro":
        shown = found.filter(F.col("source_key") == picked) if picked else found.filter(F.col("source_key").isin(*HOME))
        return shown.withColumn("place", F.col("pos"))
    if not picked:
        return found.withColumn("place", F.col("pos"))
    order = Window.partitionBy("qid").orderBy((F.col("source_key") != picked).cast("int"), F.desc("v"), "pos")
    return found.withColumn("place", F.row_number().over(order))


def ban_flags(found: DataFrame) -> DataFrame:
    """qid, banned, absolute, from the unfiltered hits."""
    home = F.col("source_key") == BAN
    return found.groupBy("qid").agg(F.bool_or(home).alias("banned"), F.bool_or(home & (F.col("v") >= 100)).alias("absolute"))


def shared_identifiers(register: DataFrame) -> DataFrame:
    """cas, names, refs: identifiers with the distinct names and the references that they have. Equal rows are counted
    before their cells are read."""
    once = register.groupBy("cas", "name").agg(F.count(F.lit(1)).alias("_refs"))
    cell = F.trim(F.coalesce("cas", F.lit("")))
    rows = once.filter((cell != "") & ~cell.rlike("(?i)see |no cas|remark|note"))
    each = rows.select(F.explode(F.split(cell, r"[\n\[\]]")).alias("c"), F.lower(F.trim("name")).alias("n"), "_refs")
    each = each.select(F.trim("c").alias("cas"), "n", "_refs").filter(F.col("cas").rlike(T.CAS))
    per = each.groupBy("cas", "n").agg(F.sum("_refs").alias("_refs"))
    return per.groupBy("cas").agg(F.count("n").alias("names"), F.sum("_refs").alias("refs"))


def match_kinds(found: DataFrame, queries: DataFrame, shared: DataFrame) -> DataFrame:
    """found with kind (candidate, cas-name, name, shared, partial) and shared."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9؀-ۿ]+", " "))
    many = shared.filter("names > 1").select(F.col("cas").alias("_cas"), F.lit(True).alias("_many"))
    df = found.join(queries.select("qid", "q"), "qid").withColumn("_first", first_cas(F.col("cas")))
    df = df.join(many, F.col("_first") == F.col("_cas"), "left")
    q, n = plain(F.col("q")), plain(F.col("name"))
    named = (q != "") & F.startswith(n, q)
    by_cas, exact = F.col("type") == "cas", F.col("type").isin("cas", "name")
    kind = (
        F.when(F.col("candidate"), "candidate").when(by_cas & named, "cas-name").when(~by_cas & exact & named, "name")
        .when(by_cas, "shared").otherwise("partial")
    )
    df = df.withColumn("kind", kind)
    is_shared = F.when(F.col("kind") == "candidate", False).when(F.col("kind") == "shared", True).otherwise(F.coalesce("_many", F.lit(False)))
    return df.withColumn("shared", is_shared).drop("_first", "_cas", "_many", "q")


def dissected_status(source: Column, status: Column, raw: Column, expiry: Column, as_of: Column) -> Column:
    """struct<key, tone> of a row's status."""
    parts = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    some = lambda w: F.exists(parts, lambda x: x.startswith(w))
    every = lambda w: F.forall(parts, lambda x: x.startswith(w))
    day = F.when(F.trim(expiry).rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(F.trim(expiry), "dd/MM/yyyy"))
    has = lambda w: F.coalesce(F.contains(raw, F.lit(w)), F.lit(False))
    eu = (
        F.when(raw == "Not approved", "eu.notapproved/amber").when(raw == "Pending", "eu.pending/neutral")
        .when((raw == "Approved") & F.coalesce(day < as_of, F.lit(False)), "eu.expired/amber")
        .when(raw == "Approved", "eu.approved/neutral").otherwise("eu.unknown/neutral")
    )
    epa = (
        F.when(has("غير مرتبط بأي منتج"), "epa.noproduct/neutral")
        .when(has("كل تسجيلاته ملغاة") | ((F.coalesce(raw, F.lit("")) != "") & every("Inactive")), "epa.cancelled/amber")
        .when(has("له تسجيل نشط") | some("Active"), "epa.registered/neutral")
        .when(F.size(parts) > 0, "epa.mixed/neutral").when(status == "مسموح", "epa.registered/neutral")
        .when(status == "محظور", "epa.cancelled/amber").otherwise("epa.mixed/neutral")
    )
    five = (
        F.when(status == "Approved", "500.approved/neutral").when(status == "RAR", "500.rar/neutral")
        .when(status == "REV", "500.rev/neutral").when(status == "REV*", "500.revstar/neutral").otherwise("500.unknown/neutral")
    )
    both = (
        F.when(source == "libya-248", "248.banned/banned").when(source == "libya-500", five).when(source == "eu", eu)
        .when(source == "epa", epa).when(source == "epa-cancelled", "epa.cancelled/amber").otherwise("unknown/neutral")
    )
    cut = F.split(both, "/")
    return F.struct(F.get(cut, F.lit(0)).alias("key"), F.get(cut, F.lit(1)).alias("tone"))


def _named(rows: DataFrame) -> DataFrame:
    """id, n (the compact name), sig (the identifiers) of rows (id, name, cas) that have a name."""
    return rows.filter(F.coalesce("name", F.lit("")) != "").select(
        "id", T.compact(T.norm(F.col("name"))).alias("n"),
        F.coalesce(F.nullif(F.array_join(T.cas_numbers(F.col("cas")), ","), F.lit("")), F.lit("none")).alias("sig"),
    )


def _near_texts(texts: DataFrame) -> DataFrame:
    """Distinct compact names (n) to pairs l, r (both ways, and each with itself) that are equal, contain one another
    (0.72 of the length at least) or are within a fifth of the longer name's edits: l, r, type, v."""
    # A name inside one that is at most 1 / 0.72 times as long is within 0.28 of the longer one's edits.
    pairs = near_pairs(texts.select(F.col("n").alias("l"), F.col("n").alias("s")), texts.select(F.col("n").alias("r"), F.col("n").alias("t")), 0.28)
    longest, least = F.greatest(F.length("l"), F.length("r")), F.least(F.length("l"), F.length("r"))
    inside = (least >= 4) & (F.contains(F.col("l"), F.col("r")) | F.contains(F.col("r"), F.col("l"))) & (least / longest >= 0.72)
    most = F.floor(longest * 0.2).cast("int")
    edits = F.levenshtein(F.col("l"), F.col("r"))
    v = T.js_round(100 - edits / longest * 100)
    fuzzy = (longest >= 8) & (edits <= most) & (v >= 80)
    return pairs.select(
        "l", "r",
        F.when(F.col("l") == F.col("r"), "same-name").when(inside, "containment").when(fuzzy, "fuzzy").alias("type"),
        F.when(F.col("l") == F.col("r"), F.lit(100).cast("bigint")).when(inside, T.js_round(least / longest * 96)).otherwise(v).alias("v"),
    ).filter("type IS NOT NULL")


def near_names(rows: DataFrame) -> DataFrame:
    """rows: id, name, cas. Pairs a < b of different identifiers whose names are near: a, b, type, v. Every pair is a row,
    so that rows should be classes' representatives (one for each name and identifier, say); near_links tells the rest."""
    keyed = _named(rows)
    pairs = _near_texts(keyed.select("n").distinct())
    a, b = keyed.toDF("a", "l", "sa"), keyed.toDF("b", "r", "sb")
    return a.join(pairs, "l").join(b, "r").filter("a < b and sa <> sb").select("a", "b", "type", "v")


def near_links(rows: DataFrame) -> DataFrame:
    """id, class (the smallest id with the same compact name), links: of every row with a name how many rows have a near
    name and other identifiers. Names are paired, rows counted, so that a name that very many rows have is no pairs."""
    keyed = written(_named(rows), "named")
    names = keyed.groupBy("n").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("all"))
    own = keyed.groupBy("n", "sig").agg(F.count(F.lit(1)).alias("same"))
    near = written(_near_texts(names.select("n")).select("l", "r"), "near")
    total = near.join(names.select(F.col("n").alias("r"), "all"), "r").groupBy(F.col("l").alias("n")).agg(F.sum("all").alias("total"))
    alike = near.join(own.select(F.col("n").alias("r"), "sig", "same"), "r").groupBy(F.col("l").alias("n"), "sig").agg(F.sum("same").alias("alike"))
    out = keyed.join(names.select("n", "class"), "n").join(total, "n", "left").join(alike, ["n", "sig"], "left")
    zero = F.lit(0).cast("bigint")
    return out.select("id", "class", (F.coalesce("total", zero) - F.coalesce("alike", zero)).alias("links"))
