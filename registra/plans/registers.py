"""Register builds: dedupes, three-way packs, partitions, numbering, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .shared import written


def _whole_row(rows: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in rows.columns])


def _row_hash(rows: DataFrame) -> Column:
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map" in t else F.col(f"`{c}`") for c, t in rows.dtypes])


def _chosen(rows: DataFrame, keys: list[str], choice: Column) -> DataFrame:
    """A row per key, chosen by an aggregate: partial per task, so that a frequent key is no group in one task."""
    keyed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    return rows.groupBy(*keyed).agg(choice.alias("_x")).select("_x.*")


def first_wins(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Per key the row that comes first by order (ascending, nulls first); ties go to the smallest hash of the row."""
    place = F.struct(*[x for c in order for x in (F.isnotnull(c), F.col(c) if isinstance(c, str) else c)], _row_hash(rows))
    return _chosen(rows, keys, F.min_by(_whole_row(rows), place))


def last_wins(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Per key the row that comes last by order (nulls first); ties go to the largest hash of the row."""
    place = F.struct(*[x for c in order for x in (F.isnotnull(c), F.col(c) if isinstance(c, str) else c)], _row_hash(rows))
    return _chosen(rows, keys, F.max_by(_whole_row(rows), place))


def longest_wins(rows: DataFrame, keys: list[str], text: str, *order: Column | str) -> DataFrame:
    """Per key the row with the longest text, the first of them by order."""
    return first_wins(rows, keys, -F.length(F.coalesce(F.col(text), F.lit(""))), *order)


def numbered(rows: DataFrame, *order: Column | str, name: str = "row") -> DataFrame:
    """Consecutive numbers in order without one task: sorted ranges, each numbered from where it starts.

    The ranges are written once and read for their sizes and for the numbers, as two evaluations of a range exchange
    may draw different bounds. Rows with equal keys are placed by the hash of the whole row, so that a frequent key is
    spread over ranges."""
    tied = rows.withColumn("_h", _row_hash(rows))
    placed = tied.repartitionByRange(*order, "_h").sortWithinPartitions(*order, "_h").withColumn("_p", F.spark_partition_id())
    placed = written(placed.withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).drop("_h"), "ranges")
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_s", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    return placed.join(starts, "_p").withColumn(name, F.col("_s") + F.col("_i") + 1).drop("_p", "_i", "_s")


def sequence_faults(rows: DataFrame, number: str, *order: Column | str) -> DataFrame:
    """Rows whose number isn't positive (fault nonpositive), is another row's too (repeated), or isn't the row's place
    in order (misplaced): the columns of rows and place, fault; a row is listed under each of its faults."""
    df = numbered(rows, *order, name="place")
    times = rows.groupBy(number).agg(F.count(F.lit(1)).alias("_t"))
    df = df.join(times, number, "left").select(*rows.columns, "place", "_t")
    n = F.col(number)
    faults = F.array(
        F.when(n.isNull() | (n <= 0), "nonpositive"), F.when(F.col("_t") > 1, "repeated"), F.when(n.isNull() | (n != F.col("place")), "misplaced")
    )
    return df.withColumn("fault", F.explode(F.filter(faults, lambda x: x.isNotNull()))).drop("_t")


def every_nth(rows: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """The first of every n / most rows (rounded down, 1 at least) in order."""
    df = numbered(rows, *order, name="_place")
    n = df.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / F.lit(most))).alias("_step"))
    return df.join(F.broadcast(n)).filter((F.col("_place") - 1) % F.col("_step") == 0).drop("_place", "_step")


def pack(links: DataFrame, constituents: DataFrame, products: DataFrame) -> DataFrame:
    """links (pcode, ccode), constituents (ccode, cname; the first wins), products (pcode, grp, registered; the
    last wins): per normalised name products, registered_products, status, category (the first 3 groups)."""
    named = first_wins(constituents, ["ccode"], "ord").select("ccode", F.upper(F.trim("cname")).alias("name"))
    known = last_wins(products, ["pcode"], "ord").select("pcode", "grp", "registered")
    rows = links.join(named, "ccode").join(known, "pcode", "left")
    groups = F.sort_array(F.collect_set("grp"))
    out = rows.groupBy("name").agg(
        F.count(F.lit(1)).alias("products"), F.count_if(F.coalesce("registered", F.lit(False))).alias("registered_products"), groups.alias("_g")
    )
    status = F.when(F.col("registered_products") > 0, "registered").otherwise("not registered")
    return out.select("name", "products", "registered_products", status.alias("status"), F.array_join(F.slice("_g", 1, 3), "; ").alias("category"))


def partition(rows: DataFrame, key: str, active: Column, cancelled: Column) -> DataFrame:
    """A class per key: active if any row is, else cancelled if all are, else none."""
    return rows.groupBy(key).agg(
        F.when(F.bool_or(active), "active").when(F.bool_and(cancelled), "cancelled").otherwise("none").alias("class"),
        F.count(F.lit(1)).alias("n"),
    )


def gaps(rows: DataFrame, number: str) -> DataFrame:
    """first, last: the runs of numbers between 1 and the largest that no row has.

    The distinct numbers are written in sorted ranges; a number's predecessor is in its own range, or the largest of
    the ranges before, of which there is one row a range."""
    n = F.col(number).cast("bigint")
    seen = rows.select(n.alias("_v")).filter("_v > 0").distinct().repartitionByRange("_v").sortWithinPartitions("_v")
    seen = written(seen.withColumn("_p", F.spark_partition_id()), "numbers")
    tops = seen.groupBy("_p").agg(F.max("_v").alias("_top"))
    tops = tops.select("_p", F.coalesce(F.max("_top").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_low"))
    before = F.lag("_v").over(Window.partitionBy("_p").orderBy("_v"))
    df = seen.withColumn("_b", before).join(F.broadcast(tops), "_p")
    first = F.coalesce("_b", "_low") + 1
    return df.filter(first < F.col("_v")).select(first.alias("first"), (F.col("_v") - 1).alias("last"))


def missing_numbers(rows: DataFrame, number: str) -> DataFrame:
    """The numbers of gaps() one by one. A long gap is cut into blocks first, so that no task spells it all out."""
    block = 1 << 16
    runs = gaps(rows, number).withColumn("_a", F.explode(F.sequence(F.col("first"), F.col("last"), F.lit(block).cast("bigint"))))
    runs = runs.select("_a", F.least(F.col("last"), F.col("_a") + block - 1).alias("_z"))
    return runs.select(F.explode(F.sequence("_a", "_z")).alias(number))


def checksum_audit(register: DataFrame) -> DataFrame:
    """Per source: rows, well_formed, failing, malformed."""
    cells = F.filter(F.transform(F.split(F.coalesce("cas", F.lit("")), r"[\n\[\]]"), lambda x: F.trim(x)), lambda x: x != "")
    each = register.select("source_key", "row_id", F.explode_outer(cells).alias("c"))
    good = F.col("c").rlike(T.CAS)
    return each.groupBy("source_key").agg(
        F.countDistinct("row_id").alias("rows"), F.count_if(good).alias("well_formed"),
        F.count_if(good & ~F.coalesce(T.cas_checksum(F.col("c")), F.lit(True))).alias("failing"), F.count_if(F.col("c").isNotNull() & ~good).alias("malformed"),
    )


def ambiguous_duplicates(register: DataFrame) -> DataFrame:
    """Rows whose identifiers differ from those of the first row of their source with the same name. The first is
    found by an aggregate and joined back, so that a frequent name is no group in one task."""
    rows = register.select("source_key", "row_id", T.norm(F.col("name")).alias("n"), F.array_join(T.cas_numbers(F.col("cas")), ",").alias("sig"))
    first = rows.groupBy("source_key", "n").agg(F.min_by("sig", "row_id").alias("first"))
    return rows.join(first, ["source_key", "n"]).filter("sig <> first").select("source_key", "row_id", "n", "sig", "first")


def memberships(substances: DataFrame, listed: DataFrame) -> DataFrame:
    """id, list_id: on a list by identifier or by name; two equi-joins instead of one with OR."""
    key = lambda c: T.squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[‐-―]", "-"))
    number = lambda c: F.nullif(F.replace(F.regexp_extract(F.coalesce(c, F.lit("")), T.CAS_SPACED, 0), F.lit(" "), F.lit("")), F.lit(""))
    s = substances.select("id", key(F.col("name")).alias("n"), number(F.col("cas")).alias("c"))
    m = listed.select("list_id", key(F.col("name")).alias("n"), number(F.col("cas")).alias("c"))
    by_cas = s.join(m.select("list_id", "c").distinct(), "c").select("id", "list_id")
    by_name = s.filter("n <> ''").join(m.select("list_id", "n").distinct(), "n").select("id", "list_id")
    return by_cas.union(by_name).distinct()


def explained(rows: DataFrame, codes: DataFrame, fallback: dict[str, str]) -> DataFrame:
    """rows (id, section, code) with meaning and via: the section's own entry, else its fallback section's."""
    pairs = codes.sparkSession.createDataFrame(list(fallback.items()), "section string, _other string")
    own = codes.select("section", T.cat_fold(F.col("code")).alias("_k"), F.col("meaning").alias("_own"))
    other = codes.select(F.col("section").alias("_other"), T.cat_fold(F.col("code")).alias("_k"), F.col("meaning").alias("_theirs"))
    df = rows.withColumn("_k", T.cat_fold(F.col("code"))).join(own, ["section", "_k"], "left").join(pairs, "section", "left")
    df = df.join(other, ["_other", "_k"], "left")
    via = F.when(F.col("_own").isNotNull(), "own").when(F.col("_theirs").isNotNull(), "fallback").otherwise("unknown")
    return df.select("id", "section", "code", F.coalesce("_own", "_theirs").alias("meaning"), via.alias("via"))


def register_diff(a: DataFrame, b: DataFrame, key: str, field: str) -> DataFrame:
    """Full outer comparison of two registers by key: class same, changed, only_a, only_b."""
    both = a.select(key, F.col(field).alias("a"), F.lit(1).alias("_a")).join(b.select(key, F.col(field).alias("b"), F.lit(1).alias("_b")), key, "full")
    kind = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return both.select(key, "a", "b", kind.alias("class"))


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of left, as many rows of each as left has more than right: each row of right absorbs one. Counts are
    compared, so that no key is a group; what is left of a key is spelled out in blocks."""
    block = 1 << 16
    each = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    absorbed = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    same = F.lit(True)
    for k in keys:
        same = same & each[k].eqNullSafe(absorbed[k])
    rest = each.join(absorbed, same, "left").select(*[each[k] for k in keys], (F.col("_n") - F.coalesce("_k", F.lit(0))).alias("_n")).filter("_n > 0")
    blocks = rest.withColumn("_a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(block).cast("bigint"))))
    size = F.least(F.lit(block).cast("bigint"), F.col("_n") - F.col("_a")).cast("int")
    return blocks.withColumn("_x", F.explode(F.array_repeat(F.lit(True), size))).select(*keys)


def parity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side (a or b), n: what one of two tables has more often than the other, with how much more."""
    counted = lambda x, name: x.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = counted(a, "_a").unionByName(counted(b, "_b"), allowMissingColumns=True).groupBy(*keys)
    both = both.agg(F.coalesce(F.max("_a"), F.lit(0)).alias("_a"), F.coalesce(F.max("_b"), F.lit(0)).alias("_b")).filter("_a <> _b")
    return both.select(*keys, F.when(F.col("_a") > F.col("_b"), "a").otherwise("b").alias("side"), F.abs(F.col("_a") - F.col("_b")).alias("n"))


def uncovered(rows: DataFrame, codes: DataFrame, fallback: dict[str, str] | None = None) -> DataFrame:
    """section, code, n: codes of rows (section, code) that no entry of codes (section, code) explains, not even one
    of the section's fallback."""
    known = codes.select("section", T.cat_fold(F.col("code")).alias("_k")).distinct()
    if fallback:
        pairs = codes.sparkSession.createDataFrame(list(fallback.items()), "_s string, section string")
        known = known.union(known.join(pairs, "section").select(F.col("_s").alias("section"), "_k")).distinct()
    asked = rows.filter("code IS NOT NULL").groupBy("section", "code").agg(F.count(F.lit(1)).alias("n"))
    return asked.withColumn("_k", T.cat_fold(F.col("code"))).join(known, ["section", "_k"], "left_anti").select("section", "code", "n")


def outside_vocabulary(rows: DataFrame, key: str, value: str, allowed: dict[str, list[str]]) -> DataFrame:
    """key, value, n: values that the key's vocabulary doesn't have; keys without a vocabulary aren't checked."""
    pairs = [(k, v) for k, vs in allowed.items() for v in vs]
    spark = rows.sparkSession
    known = spark.createDataFrame(pairs, "_k string, _v string")
    checked = spark.createDataFrame([(k,) for k in allowed], "_k string")
    found = rows.groupBy(F.col(key), F.col(value)).agg(F.count(F.lit(1)).alias("n"))
    found = found.join(checked, F.col(key) == F.col("_k"), "left_semi")
    return found.join(known, (F.col(key) == F.col("_k")) & F.col(value).eqNullSafe(F.col("_v")), "left_anti")


def ingest_counters(rows: DataFrame, key: str, cas: str) -> DataFrame:
    """One row: rows, keys, duplicates (rows beyond the first of their key), without_cas, odd_cas (not of the usual shape)."""
    c = F.trim(F.coalesce(F.col(cas), F.lit("")))
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(c == "").alias("none"), F.count_if((c != "") & ~c.rlike(T.CAS)).alias("odd"))
    zero = F.lit(0).cast("bigint")
    return per.agg(
        F.coalesce(F.sum("n"), zero).alias("rows"), F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicates"),
        F.coalesce(F.sum("none"), zero).alias("without_cas"), F.coalesce(F.sum("odd"), zero).alias("odd_cas"),
    )


def pair_rows(pairs: DataFrame, register: DataFrame) -> DataFrame:
    """pairs (a_source, a_row, b_source, b_row, ...) with the names and identifiers of both rows; found tells whether
    the register has both."""
    side = lambda x: register.select(
        F.col("source_key").alias(f"{x}_source"), F.col("row").alias(f"{x}_row"), F.col("name").alias(f"{x}_name"), F.col("cas").alias(f"{x}_cas"), F.lit(True).alias(f"_{x}")
    )
    out = pairs.join(side("a"), ["a_source", "a_row"], "left").join(side("b"), ["b_source", "b_row"], "left")
    return out.withColumn("found", F.coalesce(F.col("_a") & F.col("_b"), F.lit(False))).drop("_a", "_b")


def expected_against(register: DataFrame, expected: DataFrame, key: str, field: str) -> DataFrame:
    """Expected rows (key, field) that the register lacks or has otherwise: key, expected, actual, class."""
    out = register_diff(expected, register, key, field).filter(F.col("class").isin("only_a", "changed"))
    kind = F.when(F.col("class") == "only_a", "missing").otherwise("differs")
    return out.select(key, F.col("a").alias("expected"), F.col("b").alias("actual"), kind.alias("class"))
