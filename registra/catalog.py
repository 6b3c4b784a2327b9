"""The engine's named queries over the driver's tables, each with SQL that gives the same rows.

The tables have no register, so that parts stand for one: the name is p_name, the identifier is derived from
p_partkey, the source from p_partkey modulo 7 (see register()).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import decisions as D
from .operators import mining, search, usage
from .plans import registers as R
from .plans.shared import written

SOURCES = ("libya-248", "libya-500", "eu", "epa", "epa-cancelled", "canada", "australia")
QUERIES = [(1, "cold widgt"), (2, "blue ring"), (3, "Cold  Widget"), (4, "1001-23-3"), (5, "see remark"), (6, "smal rings"), (7, "hot gear")]
NO_CAS = ("australia",)

_QUERIES, _SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_cas(key):
    d = (F.lit(100000) + key).cast("string")
    return F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, -2, 2), F.lit("-"), (key % 10).cast("string"))


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (key % 7 + 1).cast("int"))
    cas = F.when(key % 11 == 0, "see remark").when(key % 7 == 6, "").otherwise(derived_cas(key))
    return p.select(
        key.alias("row_id"), source.alias("source_key"), (key % 7).alias("source_ordinal"), key.alias("row"),
        F.col("p_name").alias("name"), cas.alias("cas"), F.col("p_brand").alias("status"), F.col("p_size").cast("string").alias("pc_code"),
    )


def asked(spark: SparkSession) -> DataFrame:
    """As literal rows, whose size the planner knows."""
    rows = ", ".join(f"(CAST({i} AS BIGINT), '{q}')" for i, q in QUERIES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS asked(qid, q)")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(asked(spark), register(spark, sf_dir), NO_CAS)


def top(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """The first hits of each query, written once, as decisions look at them several times."""
    return written(search.ranked(found(spark, sf_dir), search.LIMITS[mode]), "top")


_DERIVED = "substr(CAST(100000 + {0} AS VARCHAR), 1, 4) || '-' || right(CAST(100000 + {0} AS VARCHAR), 2) || '-' || ({0} % 10)"
_NAMES = ", ".join(f"'{x}'" for x in SOURCES)
_REG = f"""reg AS (
  SELECT p_partkey AS row_id, ([{_NAMES}])[p_partkey % 7 + 1] AS source_key, p_partkey % 7 AS source_ordinal, p_partkey AS row,
    p_name AS name, CASE WHEN p_partkey % 11 = 0 THEN 'see remark' WHEN p_partkey % 7 = 6 THEN '' ELSE {_DERIVED.format("p_partkey")} END AS cas,
    p_brand AS status, CAST(p_size AS VARCHAR) AS pc_code
  FROM part
), asked(qid, q) AS (VALUES {", ".join(f"(CAST({i} AS BIGINT), '{q}')" for i, q in QUERIES)})"""
_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ./-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_COMPACT = "regexp_replace({0}, '[ ./-]', '', 'g')"


def _rule(prev: str, nq: str, cq: str, key: str, short: str, field: str) -> str:
    """Two CTE columns: containment, then edits, over the state (v, type, field) of prev."""
    ratio = f"(least(length({nq}), length({key})) / greatest(length({nq}), length({key}), 1)::DOUBLE)"
    return f"""{prev}a AS (
  SELECT * EXCLUDE (v, type, field), CASE WHEN w THEN CAST(floor(r * 96 + 0.5) AS BIGINT) ELSE v END AS v,
    CASE WHEN w THEN 'partial' ELSE type END AS type, CASE WHEN w THEN '{field}' ELSE field END AS field
  FROM (SELECT *, coalesce({key} IS NOT NULL AND NOT skip AND length({nq}) >= 4 AND length({key}) >= 4 AND r >= 0.72
      AND (contains({key}, {nq}) OR contains({nq}, {key})) AND r * 96 > v, false) AS w
    FROM (SELECT * EXCLUDE (r, w), {ratio} AS r FROM {prev}))
), {prev}b AS (
  SELECT * EXCLUDE (v, type, field), CASE WHEN w2 THEN CAST(floor(e + 0.5) AS BIGINT) ELSE v END AS v,
    CASE WHEN w2 THEN 'similar' ELSE type END AS type, CASE WHEN w2 THEN '{field}' ELSE field END AS field
  FROM (SELECT * EXCLUDE (e, w2), 100 - levenshtein({cq}, {short}) / greatest(length({cq}), length({short}), 1)::DOUBLE * 100 AS e,
      coalesce({key} IS NOT NULL AND NOT skip AND greatest(length({cq}), length({short})) > 0
        AND 100 - levenshtein({cq}, {short}) / greatest(length({cq}), length({short}), 1)::DOUBLE * 100 > v, false) AS w2
    FROM {prev}a)
)"""


_HITS = f"""{_REG}, k AS (
  SELECT reg.*, CASE WHEN name <> '' THEN {_NORM.format("name")} END AS nname, CASE WHEN cas <> '' THEN {_NORM.format("cas")} END AS ncas,
    regexp_matches(cas, '\\d{{2,7}}-\\d{{2}}-\\d') AS numbered
  FROM reg
), qk AS (
  SELECT qid, q, {_NORM.format("q")} AS nq, regexp_matches(trim(q), '^\\d{{2,7}}-\\d{{2}}-\\d$') AS by_cas FROM asked
), j0 AS (
  SELECT *, {_COMPACT.format("nq")} AS cq, {_COMPACT.format("nname")} AS cname, {_COMPACT.format("ncas")} AS ccas,
    nq = nname AS exact, false AS skip, 0::BIGINT AS v, '' AS type, '' AS field, 0.0::DOUBLE AS r, false AS w, 0.0::DOUBLE AS e, false AS w2
  FROM qk, k WHERE NOT (by_cas AND numbered)
), {_rule("j0", "nq", "cq", "nname", "cname", "name")}, j1 AS (
  SELECT * EXCLUDE (v, type, field, skip), coalesce(nq = ncas AND v < 100, false) AS skip,
    CASE WHEN nq = ncas AND v < 100 THEN 100 ELSE v END AS v, CASE WHEN nq = ncas AND v < 100 THEN 'name' ELSE type END AS type,
    CASE WHEN nq = ncas AND v < 100 THEN 'cas' ELSE field END AS field
  FROM j0b
), {_rule("j1", "nq", "cq", "ncas", "ccas", "cas")}, hits AS (
  SELECT qid, row_id, source_key, source_ordinal, row, name, cas, status, pc_code, CASE WHEN exact THEN 100 ELSE v END AS v,
    CASE WHEN exact THEN 'name' ELSE type END AS type, CASE WHEN exact OR field = 'name' THEN name ELSE cas END AS field,
    coalesce(exact, false) AS decisive, source_key = 'australia' AND NOT coalesce(exact, false) AS candidate
  FROM j1b WHERE coalesce(exact, false) OR v >= 80
  UNION ALL
  SELECT qid, row_id, source_key, source_ordinal, row, name, cas, status, pc_code, 100, 'cas', trim(q), false, false
  FROM qk, k WHERE by_cas AND numbered AND cas = trim(q)
)"""
_RANK = "CASE source_key WHEN 'libya-248' THEN 0 WHEN 'libya-500' THEN 1 WHEN 'eu' THEN 2 WHEN 'epa' THEN 3 WHEN 'epa-cancelled' THEN 4 ELSE 99 END"
_TOP = f"""{_HITS}, top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_RANK}, v DESC, source_ordinal, row_id) AS pos FROM hits) WHERE pos <= @K@
)"""
_TOP16, _TOP80 = _TOP.replace("@K@", "16"), _TOP.replace("@K@", "80")
_HIT = ("qid", "row_id", "source_key", "v", "type", "field", "decisive", "candidate", "pos")


@query(f"WITH {_TOP16} SELECT {', '.join(_HIT)} FROM top")
def search_topk_farmer(spark, d):
    return search.ranked(found(spark, d), search.LIMITS["farmer"]).select(*_HIT)


@query(f"WITH {_TOP80} SELECT {', '.join(_HIT)} FROM top")
def search_topk_pro(spark, d):
    return search.ranked(found(spark, d), search.LIMITS["pro"]).select(*_HIT)


@query(f"WITH {_HITS} SELECT qid, row_id, v, type, field FROM hits WHERE type = 'cas'")
def search_cas_exact(spark, d):
    return found(spark, d).filter("type = 'cas'").select("qid", "row_id", "v", "type", "field")


@query(f"WITH {_HITS} SELECT qid, row_id, v, type FROM hits WHERE candidate")
def search_no_cas_candidates(spark, d):
    return found(spark, d).filter("candidate").select("qid", "row_id", "v", "type")


@query(
    f"""WITH {_HITS} SELECT batch, row_id, qid, v, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY batch ORDER BY CASE WHEN source_key = 'epa-cancelled' THEN 99 ELSE {_RANK} END, v DESC, source_ordinal, row_id) AS pos
  FROM (SELECT *, qid % 2 AS batch, row_number() OVER (PARTITION BY qid % 2, row_id ORDER BY v DESC, qid) AS n FROM hits) WHERE n = 1
) WHERE pos <= 24"""
)
def merge_best_per_row(spark, d):
    return search.merged(found(spark, d).withColumn("batch", F.col("qid") % 2)).select("batch", "row_id", "qid", "v", "pos")


_JUDGED = f"""{_TOP16}, l AS (SELECT row_id, source_key, cas, lower(name) AS s FROM reg),
qn AS (
  SELECT qid, trim(regexp_replace(regexp_replace(lower(q), '\\s*-\\s*', '-', 'g'), '\\s+', ' ', 'g')) AS q FROM asked WHERE NOT regexp_matches(q, '^\\d{{2,7}}-\\d{{2}}-\\d$')
), cand AS (SELECT qid, row_id FROM top UNION SELECT qid, row_id FROM qn JOIN l ON q = s), judged AS (
  SELECT qid, row_id, source_key, cas, CASE WHEN q = s THEN 'exact' WHEN contains(q, s) OR contains(s, q) THEN 'similar'
    WHEN array_to_string(regexp_extract_all(q, '\\d+'), ' ') <> array_to_string(regexp_extract_all(s, '\\d+'), ' ') THEN 'similar'
    WHEN levenshtein(q, s) <= CASE WHEN least(length(q), length(s)) < 5 THEN 0 WHEN least(length(q), length(s)) <= 8 THEN 1 ELSE 2 END THEN 'probable' END AS verdict
  FROM cand JOIN qn USING (qid) JOIN l USING (row_id)
)"""


@query(f"WITH {_JUDGED} SELECT qid, row_id, verdict FROM judged WHERE verdict IS NOT NULL")
def judge_name_verdict(spark, d):
    return D.verdicts(asked(spark), register(spark, d), top(spark, d, "farmer")).select("qid", "row_id", "verdict")


@query(
    f"""WITH {_JUDGED}, g AS (
  SELECT qid, source_key, count(*) AS entries, count(*) FILTER (WHERE verdict = 'exact') AS x, count(*) FILTER (WHERE verdict = 'probable') AS p,
    count(DISTINCT nullif(regexp_extract(cas, '\\d+-\\d+-\\d'), '')) AS kinds
  FROM judged WHERE verdict IS NOT NULL GROUP BY qid, source_key
) SELECT qid, source_key, CASE WHEN x > 0 THEN 'exact' WHEN p > 0 THEN 'probable' ELSE 'similar' END AS verdict, entries,
  kinds > 1 AND CASE WHEN x > 0 THEN x ELSE p END > 1 AS ambiguous FROM g"""
)
def judge_per_source(spark, d):
    reg = register(spark, d)
    return D.per_source(D.verdicts(asked(spark), reg, top(spark, d, "farmer")), reg)


_DIGITS = "[CAST(x AS INTEGER) FOR x IN string_split(reverse(replace(cas, '-', '')), '')]"
_SUM_OK = f"list_sum([{_DIGITS}[i + 1] * i FOR i IN range(1, len({_DIGITS}))]) % 10 = ({_DIGITS})[1]"


@query(
    f"WITH {_REG} SELECT qid, trim(q) AS cas, source_key, row_id, CASE WHEN {_SUM_OK} THEN 'exact' ELSE 'probable' END AS verdict "
    "FROM asked JOIN reg ON trim(q) = cas WHERE regexp_matches(q, '^\\d+-\\d+-\\d$')"
)
def judge_cas_verdict(spark, d):
    return D.cas_verdict(asked(spark), register(spark, d))


@query(f"WITH c AS (SELECT p_partkey, {_DERIVED.format('p_partkey')} AS cas FROM part) SELECT p_partkey, cas, {_SUM_OK} AS ok FROM c")
def cas_checksum(spark, d):
    c = derived_cas(F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", c.alias("cas"), T.cas_checksum(c).alias("ok"))


@query(
    f"""WITH {_REG}, e AS (SELECT source_key, row_id, nullif(cas, '') AS cas, regexp_matches(cas, '^\\d{{2,7}}-\\d{{2}}-\\d$') AS good FROM reg)
SELECT source_key, count(DISTINCT row_id) AS rows, count(*) FILTER (WHERE good) AS well_formed,
  count(*) FILTER (WHERE CASE WHEN good THEN NOT ({_SUM_OK}) ELSE false END) AS failing, count(*) FILTER (WHERE cas IS NOT NULL AND NOT good) AS malformed
FROM e GROUP BY source_key"""
)
def cas_audit(spark, d):
    return R.checksum_audit(register(spark, d))


@query(
    f"""WITH {_TOP80}, s AS (
  SELECT qid, row_id, v, CASE WHEN regexp_matches(cas, '\\d{{2,7}}-\\d{{2}}-\\d') THEN cas ELSE '' END AS sig,
    row_number() OVER (PARTITION BY qid ORDER BY v DESC, pos) AS i, max(v) OVER (PARTITION BY qid) AS top_v FROM top
), p AS (
  SELECT a.qid, a.row_id AS first, b.row_id AS second, row_number() OVER (PARTITION BY a.qid ORDER BY a.i, b.i) AS n
  FROM s a JOIN s b ON a.qid = b.qid AND a.i < b.i
  WHERE a.row_id <> b.row_id AND a.sig <> b.sig AND a.v - b.v < 8 AND (a.top_v < 100 OR a.i = 1)
), t AS (SELECT qid, count(*) FILTER (WHERE top_v - v < 8) AS tier, min(row_id) FILTER (WHERE i = 1) AS leader FROM s GROUP BY qid)
SELECT qid, leader, first, second, tier FROM p JOIN t USING (qid) WHERE n = 1"""
)
def ambiguity_pairs(spark, d):
    return D.ambiguity(top(spark, d, "pro"))


_COLLAPSE = """, ident AS (
  SELECT *, CASE WHEN regexp_matches(trim(field), '^\\d{2,7}-\\d{2}-\\d$') THEN 'cas:' || trim(field) ELSE 'name:' || lower(name) END AS ident FROM src
), g AS (
  SELECT qid, source_key, ident, count(DISTINCT trim(status)) AS ns, count(DISTINCT nullif(pc_code, '')) AS nc, min(pos) AS first_pos FROM ident GROUP BY ALL
), m AS (
  SELECT qid, source_key, ident, count(*) AS nm, string_agg(cas, ',' ORDER BY p) AS cs
  FROM (SELECT qid, source_key, ident, cas, min(pos) AS p FROM ident WHERE cas <> '' GROUP BY ALL) GROUP BY ALL
), c AS (
  SELECT *, row_number() OVER (PARTITION BY qid, source_key, ident ORDER BY v DESC, row) AS n FROM ident
) SELECT c.qid, c.row_id, c.v, g.first_pos, CASE WHEN ns <= 1 AND nc <= 1 AND nm > 1 THEN cs END AS merged_cas
  FROM c JOIN g USING (qid, source_key, ident) LEFT JOIN m USING (qid, source_key, ident) WHERE ns > 1 OR nc > 1 OR n = 1"""
_COLLAPSED = ("qid", "row_id", "v", "first_pos", "merged_cas")


@query(f"WITH {_TOP80}, src AS (SELECT * FROM top)" + _COLLAPSE)
def collapse_same_source(spark, d):
    return D.collapse_same_source(top(spark, d, "pro")).select(*_COLLAPSED)


@query(f"WITH {_TOP80}, src AS (SELECT * REPLACE ('listed' AS status, '' AS pc_code) FROM top)" + _COLLAPSE)
def collapse_merged(spark, d):
    """Hits of a register that has neither statuses nor codes of its own, so that they do collapse."""
    hits = top(spark, d, "pro").withColumn("status", F.lit("listed")).withColumn("pc_code", F.lit(""))
    return D.collapse_same_source(hits).select(*_COLLAPSED)


_VIA = """, sure AS (SELECT qid, lower(name) || '|' || cas AS what, string_split(lower(via), ' ') AS words FROM hit WHERE decisive), src AS (
  SELECT h.* FROM hit h WHERE qid IN (SELECT qid FROM sure) AND (
    lower(name) || '|' || cas IN (SELECT what FROM sure WHERE sure.qid = h.qid)
    OR (via <> '' AND NOT EXISTS (SELECT 1 FROM sure WHERE sure.qid = h.qid AND list_has_all(words, string_split(lower(via), ' '))))
  )
)"""


@query(
    f"WITH {_TOP80}, hit AS (SELECT *, '' AS via FROM top){_VIA}" + _COLLAPSE
    + " UNION ALL SELECT qid, row_id, v, NULL, NULL FROM top WHERE qid NOT IN (SELECT qid FROM sure)"
)
def collapse_decisive(spark, d):
    return D.collapse_to_decisive(top(spark, d, "pro").withColumn("via", F.lit(""))).select(*_COLLAPSED)


@query(
    f"WITH {_TOP80}, hit AS (SELECT *, name AS via FROM top){_VIA}" + _COLLAPSE
    + " UNION ALL SELECT qid, row_id, v, NULL, NULL FROM top WHERE qid NOT IN (SELECT qid FROM sure)"
)
def collapse_reads(spark, d):
    """As collapse_decisive, each hit having come from a read of its own name's words."""
    return D.collapse_to_decisive(top(spark, d, "pro").withColumn("via", F.col("name"))).select(*_COLLAPSED)


@query(f"WITH {_TOP16} SELECT qid, row_id, pos AS place FROM top WHERE source_key IN ('libya-248', 'libya-500')")
def context_filter(spark, d):
    return D.in_context(top(spark, d, "farmer"), "farmer").select("qid", "row_id", F.col("place").cast("bigint").alias("place"))


@query(f"WITH {_TOP80} SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY source_key <> 'eu', v DESC, pos) AS place FROM top")
def jurisdiction_sort(spark, d):
    return D.in_context(top(spark, d, "pro"), "pro", "eu").select("qid", "row_id", F.col("place").cast("bigint").alias("place"))


@query(f"WITH {_HITS} SELECT qid, bool_or(source_key = 'libya-248') AS banned, bool_or(source_key = 'libya-248' AND v >= 100) AS absolute FROM hits GROUP BY qid")
def ban_flag(spark, d):
    return D.ban_flags(found(spark, d))


@query(
    f"""WITH {_TOP80} SELECT qid, row_id, CASE WHEN candidate THEN 'candidate' WHEN type = 'cas' AND named THEN 'cas-name'
  WHEN type = 'name' AND named THEN 'name' WHEN type = 'cas' THEN 'shared' ELSE 'partial' END AS kind, NOT candidate AND type = 'cas' AND NOT named AS shared
FROM (SELECT top.*, starts_with({_NORM.format("name")}, {_NORM.format("q")}) AS named FROM top JOIN asked USING (qid))"""
)
def match_kind(spark, d):
    reg = register(spark, d)
    return D.match_kinds(top(spark, d, "pro"), asked(spark), D.shared_identifiers(reg)).select("qid", "row_id", "kind", "shared")


@query(
    """WITH n AS (SELECT min(p_partkey) AS id, p_name AS name, replace(p_name, ' ', '') AS n FROM part GROUP BY p_name),
p AS (
  SELECT a.id AS a, b.id AS b, a.n AS x, b.n AS y, greatest(length(a.n), length(b.n)) AS m, least(length(a.n), length(b.n)) AS l
  FROM n a JOIN n b ON a.id < b.id
), t AS (
  SELECT *, CASE WHEN x = y THEN 'same-name' WHEN l >= 4 AND (contains(x, y) OR contains(y, x)) AND l / m::DOUBLE >= 0.72 THEN 'containment'
    WHEN m >= 8 AND levenshtein(x, y) <= floor(m * 0.2) AND floor(100 - levenshtein(x, y) / m::DOUBLE * 100 + 0.5) >= 80 THEN 'fuzzy' END AS type FROM p
) SELECT a, b, type, CAST(CASE type WHEN 'same-name' THEN 100 WHEN 'containment' THEN floor(l / m::DOUBLE * 96 + 0.5)
    ELSE floor(100 - levenshtein(x, y) / m::DOUBLE * 100 + 0.5) END AS BIGINT) AS v FROM t WHERE type IS NOT NULL"""
)
def near_pairs(spark, d):
    names = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return D.near_names(names.withColumn("cas", derived_cas(F.col("id"))))


@query(
    f"""WITH {_REG}, k AS (SELECT row_id AS id, replace(name, ' ', '') AS n, CASE WHEN regexp_matches(cas, '\\d{{2,7}}-\\d{{2}}-\\d') THEN cas ELSE 'none' END AS sig FROM reg),
d AS (SELECT n, min(id) AS class FROM k GROUP BY n),
p AS (SELECT a.n AS x, b.n AS y, greatest(length(a.n), length(b.n)) AS m, least(length(a.n), length(b.n)) AS l FROM d a, d b),
t AS (
  SELECT x, y FROM p WHERE x = y OR l >= 4 AND (contains(x, y) OR contains(y, x)) AND l / m::DOUBLE >= 0.72
    OR m >= 8 AND levenshtein(x, y) <= floor(m * 0.2) AND floor(100 - levenshtein(x, y) / m::DOUBLE * 100 + 0.5) >= 80
), c AS (SELECT n, sig, count(*) AS same FROM k GROUP BY n, sig)
SELECT k.id, d.class, CAST(coalesce((SELECT sum(same) FROM t JOIN c ON c.n = t.y WHERE t.x = k.n AND c.sig <> k.sig), 0) AS BIGINT) AS links FROM k JOIN d USING (n)"""
)
def near_name_links(spark, d):
    """Every row of the register with its class and its number of links."""
    return D.near_links(register(spark, d).select(F.col("row_id").alias("id"), "name", "cas"))


@query(f"SELECT {_DERIVED.format('l_suppkey')} AS cas, count(DISTINCT l_partkey) AS names, count(*) AS refs FROM lineitem GROUP BY l_suppkey")
def shared_identifier(spark, d):
    rows = table(spark, d, "lineitem").select(derived_cas(F.col("l_suppkey")).alias("cas"), F.concat(F.lit("Part "), "l_partkey").alias("name"))
    return D.shared_identifiers(rows)


_SIG = "CASE WHEN regexp_matches(cas, '\\d{2,7}-\\d{2}-\\d') THEN cas ELSE '' END"


@query(f"""WITH {_REG}, s AS (SELECT source_key, row_id, {_NORM.format("name")} AS n, {_SIG} AS sig FROM reg), f AS (
  SELECT *, first_value(sig) OVER (PARTITION BY source_key, n ORDER BY row_id) AS first FROM s) SELECT * FROM f WHERE sig <> first""")
def ambiguous_duplicates(spark, d):
    return R.ambiguous_duplicates(register(spark, d))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '  (' || p_brand || ')'), '[^a-z0-9\\s./-]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM part")
def norm_names(spark, d):
    return table(spark, d, "part").select("p_partkey", T.norm(F.concat("p_name", F.lit("  ("), "p_brand", F.lit(")"))).alias("name"))


@query("SELECT s_suppkey, regexp_replace(lower(replace(s_name, '#', ' ')), '[\\s./-]', '', 'g') AS name FROM supplier")
def compact_names(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.compact(T.norm(F.col("s_name"))).alias("name"))


_EXPIRY = "strftime(o_orderdate, '%d/%m/%Y')"


@query(
    f"""SELECT o_orderkey, CASE WHEN s = 'eu' THEN CASE o_orderstatus WHEN 'F' THEN 'eu.notapproved' WHEN 'P' THEN 'eu.pending'
      ELSE CASE WHEN CAST(o_orderdate AS DATE) < DATE '1999-01-01' THEN 'eu.expired' ELSE 'eu.approved' END END
    WHEN s = 'libya-248' THEN '248.banned' ELSE CASE o_orderstatus WHEN 'F' THEN '500.rar' WHEN 'P' THEN '500.rev' ELSE '500.approved' END END AS key,
  CASE WHEN s = 'libya-248' THEN 'banned' WHEN s = 'eu' AND (o_orderstatus = 'F' OR o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) < DATE '1999-01-01') THEN 'amber' ELSE 'neutral' END AS tone
FROM (SELECT *, (['eu', 'libya-248', 'libya-500'])[o_orderkey % 3 + 1] AS s FROM orders)"""
)
def status_dissect(spark, d):
    o = table(spark, d, "orders")
    s = F.element_at(F.array(F.lit("eu"), F.lit("libya-248"), F.lit("libya-500")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    raw = F.when(F.col("o_orderstatus") == "F", "Not approved").when(F.col("o_orderstatus") == "P", "Pending").otherwise("Approved")
    st = F.when(F.col("o_orderstatus") == "F", "RAR").when(F.col("o_orderstatus") == "P", "REV").otherwise("Approved")
    x = D.dissected_status(s, st, raw, F.date_format("o_orderdate", "dd/MM/yyyy"), F.to_date(F.lit("1999-01-01")))
    return o.select("o_orderkey", x["key"].alias("key"), x["tone"].alias("tone"))


@query("SELECT part, count(*) AS n FROM (SELECT unnest(string_split(p_type || '/' || p_brand, '/')) AS part FROM part) GROUP BY part")
def category_breakdown(spark, d):
    parts = T.code_parts(F.concat("p_type", F.lit("/"), "p_brand"), F.array().cast("array<string>"))
    return table(spark, d, "part").select(F.explode(parts).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


CODES = [("a", "ECONOMY", "cheap"), ("a", "SMALL", "little"), ("b", "PROMO", "offer"), ("b", "STANDARD", "plain"), ("b", "SMALL", "other")]


@query(
    f"""WITH codes(section, code, meaning) AS (VALUES {", ".join(map(str, CODES))}), r AS (SELECT p_partkey AS id, 'a' AS section, p_type AS code FROM part)
SELECT id, r.section, r.code, coalesce(x.meaning, y.meaning) AS meaning,
  CASE WHEN x.meaning IS NOT NULL THEN 'own' WHEN y.meaning IS NOT NULL THEN 'fallback' ELSE 'unknown' END AS via
FROM r LEFT JOIN codes x ON x.section = 'a' AND x.code = r.code LEFT JOIN codes y ON y.section = 'b' AND y.code = r.code"""
)
def code_lookup_fallback(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("a").alias("section"), F.col("p_type").alias("code"))
    return R.explained(rows, spark.createDataFrame(CODES, "section string, code string, meaning string"), {"a": "b"})


@query(
    f"""WITH {_REG}, m AS (
  SELECT p_type AS list_id, p_name AS name, '' AS cas FROM part UNION ALL SELECT 'suppliers', s_name, {_DERIVED.format("s_suppkey")} FROM supplier
)
SELECT DISTINCT row_id AS id, list_id FROM reg JOIN m ON reg.cas = m.cas AND regexp_matches(reg.cas, '^\\d') UNION
SELECT DISTINCT row_id, list_id FROM reg JOIN (SELECT DISTINCT list_id, lower(name) AS n FROM m) m ON lower(reg.name) = m.n"""
)
def alert_membership(spark, d):
    reg = register(spark, d).select(F.col("row_id").alias("id"), "name", "cas")
    named = table(spark, d, "part").select(F.col("p_type").alias("list_id"), F.col("p_name").alias("name"), F.lit("").alias("cas"))
    numbered = table(spark, d, "supplier").select(F.lit("suppliers").alias("list_id"), F.col("s_name").alias("name"), derived_cas(F.col("s_suppkey")).alias("cas"))
    return R.memberships(reg, named.union(numbered))


@query(
    """WITH r AS (SELECT upper(p_name) AS name, l.l_suppkey, s_nationkey, s_acctbal > 0 AS ok FROM lineitem l JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey)
SELECT name, count(*) AS products, count(*) FILTER (WHERE ok) AS registered_products,
  CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN 'registered' ELSE 'not registered' END AS status,
  array_to_string((list_sort(list(DISTINCT CAST(s_nationkey AS VARCHAR)) FILTER (WHERE s_nationkey IS NOT NULL)))[1:3], '; ') AS category FROM r GROUP BY name"""
)
def pack_build_three_way(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pcode"), F.col("l_partkey").alias("ccode"))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("ccode"), F.col("p_name").alias("cname"), F.lit(0).alias("ord"))
    products = table(spark, d, "supplier").select(F.col("s_suppkey").alias("pcode"), F.col("s_nationkey").cast("string").alias("grp"), (F.col("s_acctbal") > 0).alias("registered"), F.lit(0).alias("ord"))
    return R.pack(links, names, products)


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'active' WHEN bool_and(o_orderstatus = 'O') THEN 'cancelled' ELSE 'none' END AS class, count(*) AS n FROM orders GROUP BY o_custkey")
def registry_partition(spark, d):
    return R.partition(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def active_anti_join(spark, d):
    active = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(active, "c_custkey", "left_anti")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedupe_first_wins(spark, d):
    return R.first_wins(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY length(coalesce(text, '')) DESC, doc_id) AS n FROM documents) WHERE n = 1")
def dedupe_longest(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    return R.longest_wins(rows, ["lang", "source"], "text", "doc_id").select("lang", "source", "doc_id")


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row FROM orders")
def renumber_rows(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return R.numbered(rows, "o_totalprice", "o_orderkey").select("o_orderkey", "o_orderpriority", "row")


@query("SELECT n AS doc_id FROM (SELECT unnest(range(1, (SELECT max(doc_id) FROM labels) + 1)) AS n) WHERE n NOT IN (SELECT doc_id FROM labels)")
def sequence_check(spark, d):
    return R.missing_numbers(table(spark, d, "labels"), "doc_id")


@query(
    """WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS t FROM orders)
SELECT o_orderkey, place, 'repeated' AS fault FROM n WHERE t > 1 UNION ALL SELECT o_orderkey, place, 'misplaced' FROM n WHERE o_custkey <> place
UNION ALL SELECT o_orderkey, place, 'nonpositive' FROM n WHERE o_custkey <= 0"""
)
def sequence_faults(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.sequence_faults(rows, "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "place", "fault")


@query(
    """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, greatest(1, count(*) OVER () // 100) AS step FROM orders)
WHERE i % step = 0"""
)
def every_nth(spark, d):
    return R.every_nth(table(spark, d, "orders").select("o_orderkey"), 100, "o_orderkey")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def history_last50(spark, d):
    return usage.newest(table(spark, d, "events"), "ts", "event_id", 50).select("event_id")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def ring_100(spark, d):
    return usage.newest(table(spark, d, "events"), "ts", "event_id", 100).select("event_id")


def _events(spark, d):
    return table(spark, d, "events").withColumnRenamed("event_type", "name")


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) AS x FROM events ORDER BY x DESC LIMIT 10)")
def retention(spark, d):
    return usage.retained(_events(spark, d), 10).select("event_id")


@query("SELECT CAST(ts AS DATE) AS day, event_type AS name, count(*) AS n FROM events GROUP BY ALL")
def usage_daily(spark, d):
    return usage.daily(_events(spark, d))


@query("SELECT day, base, hit, CASE WHEN base > 0 THEN CAST(floor(100.0 * hit / base + 0.5) AS BIGINT) END AS rate FROM (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'view') AS base, count(*) FILTER (WHERE event_type = 'purchase') AS hit FROM events GROUP BY 1)")
def usage_hit_rate(spark, d):
    return usage.hit_rates(_events(spark, d), "purchase", "view")


@query("SELECT day, n, n / (max(n) OVER ())::DOUBLE AS share FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1 ORDER BY 1 DESC LIMIT 14)")
def usage_14d(spark, d):
    return usage.activity(_events(spark, d), ("click", "view"))


@query("SELECT event_id, recent FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error') WHERE recent >= 2")
def error_burst(spark, d):
    return usage.bursts(_events(spark, d), "error", "user_id", 2, 86_400_000).select("event_id", "recent")


@query(
    """WITH r AS (SELECT conv_id AS scan_id, turn AS read, length(text) % 100 AS conf, regexp_extract_all(text, '\\d{2,7}-\\d{2}-\\d') AS cas,
  list_distinct(list_filter([regexp_replace(lower(x), '[^a-z]', '', 'g') FOR x IN regexp_split_to_array(text, '[ \\t\\n\\r]+')], lambda x: x <> '')) AS names FROM conversations),
v AS (SELECT a.scan_id, a.read, a.conf, count(*) FILTER (WHERE a.read = b.read OR CASE WHEN len(a.cas) > 0 AND len(b.cas) > 0 THEN list_has_any(a.cas, b.cas) ELSE list_has_any(a.names, b.names) OR
    len([1 FOR x IN a.names IF len([1 FOR y IN b.names IF length(x) >= 6 AND length(y) >= 6 AND (contains(x, y) OR contains(y, x))]) > 0]) > 0 END) AS votes
  FROM r a JOIN r b USING (scan_id) GROUP BY ALL)
SELECT scan_id, read, votes, CAST(conf * least(votes, 12) AS BIGINT) AS pooled, row_number() OVER (PARTITION BY scan_id ORDER BY votes DESC, conf * least(votes, 12) DESC, read) AS place FROM v"""
)
def frame_vote(spark, d):
    """Turns of a conversation as reads of a scan, by all their words and identifiers."""
    words = F.transform(F.split("text", "[ \\t\\n\\r]+"), lambda x: F.regexp_replace(F.lower(x), "[^a-z]", ""))
    names = F.array_distinct(F.filter(words, lambda x: x != ""))
    reads = table(spark, d, "conversations").select(F.col("conv_id").alias("scan_id"), F.col("turn").alias("read"), T.cas_numbers(F.col("text")).alias("cas"), names.alias("names"), (F.length("text") % 100).alias("conf"))
    v = mining.votes(reads)
    return v.select("scan_id", "read", "votes", F.col("pooled").cast("bigint").alias("pooled"), F.col("place").cast("bigint").alias("place"))


_RATIO = "CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(regexp_replace(text, '\\s', '', 'g'))::DOUBLE ELSE 1.0 END"


@query(f"SELECT doc_id, round(r, 9) AS ratio, CASE WHEN r < 0.6 THEN 'mixed' WHEN doc_id % 100 < 45 THEN 'conf' END AS reason FROM (SELECT doc_id, {_RATIO} AS r FROM documents)")
def latin_ratio_gate(spark, d):
    none = F.array().cast("array<string>")
    rows = table(spark, d, "documents").select("doc_id", "text", T.latin_ratio(F.col("text")).alias("r"))
    reason = T.rejected_reason(F.col("text"), none, F.col("doc_id") % 100, F.col("r"))
    return rows.select("doc_id", F.round("r", 9).alias("ratio"), reason.alias("reason"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text || ' x' || chr(1576) || 'y', '[\\p{L}\\p{M}]+'), lambda w: regexp_matches(w, '[\\x{0600}-\\x{06FF}]') AND regexp_matches(w, '\\p{Latin}'))) AS BIGINT) AS n FROM documents")
def mixed_script(spark, d):
    text = F.concat(F.col("text"), F.lit(" x" + chr(1576) + "y"))
    return table(spark, d, "documents").select("doc_id", F.size(T.mixed_script_words(text)).cast("bigint").alias("n"))


@query("SELECT page_id, CAST(len(regexp_extract_all(coalesce(html, '') || chr(19968) || chr(65533), '[\\x{FFFD}\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{FF00}-\\x{FFEF}]')) AS BIGINT) AS n FROM pages")
def cjk_scan(spark, d):
    text = F.concat(F.coalesce("html", F.lit("")), F.lit(chr(19968) + chr(65533)))
    return table(spark, d, "pages").select("page_id", T.foreign_characters(text).cast("bigint").alias("n"))


_SPACES = "[ \\t\\n\\x0b\\f\\r\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
_MARKS = _SPACES[1:-1]
_LETTER = "[A-Za-z\\x{0600}-\\x{06FF}]"
_CANDIDATES = f"""l AS (
  SELECT doc_id, i, regexp_replace(regexp_replace(x, '^{_SPACES}+', ''), '{_SPACES}+$', '') AS line
  FROM (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') AS s FROM texts))
), h AS (
  SELECT *, regexp_matches(line, '(?i)active\\s*ingredients?') AND NOT regexp_matches(line, '(?i)\\bin\\s*active') AS header FROM l
), c AS (SELECT *, bool_or(header) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM h),
k AS (
  SELECT *, bool_or(header) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS prio,
    first_value(near) OVER (PARTITION BY doc_id, line ORDER BY i) AS ctx, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j
  FROM c WHERE length(line) BETWEEN CASE WHEN near THEN 3 ELSE 4 END AND 60 AND regexp_matches(line, '{_LETTER}{{3}}')
), w AS (
  SELECT *, trim(regexp_replace(regexp_replace(line, '[^A-Za-z0-9_{_MARKS}\\x{{0600}}-\\x{{06FF}}.-]', ' ', 'g'), '{_SPACES}+', ' ', 'g')) AS clean FROM k
), f AS (
  SELECT *, CASE WHEN length(clean) < CASE WHEN ctx THEN 3 ELSE 4 END THEN [] ELSE list_filter(string_split(clean, ' '), lambda x:
      length(x) >= CASE WHEN ctx THEN 3 ELSE 4 END AND regexp_matches(x, CASE WHEN ctx THEN '^{_LETTER}+$' ELSE '{_LETTER}' END)) END AS own,
    CASE WHEN length(clean) < CASE WHEN near THEN 3 ELSE 4 END THEN [] ELSE list_filter(string_split(clean, ' '), lambda x:
      length(x) >= CASE WHEN near THEN 3 ELSE 4 END AND regexp_matches(x, CASE WHEN near THEN '^{_LETTER}+$' ELSE '{_LETTER}' END)) END AS words
  FROM w
), g AS (
  SELECT doc_id, j, words AS a, lead(words) OVER (PARTITION BY doc_id ORDER BY j) AS b, lead(words, 2) OVER (PARTITION BY doc_id ORDER BY j) AS c FROM f
), r AS (
  SELECT doc_id, CASE WHEN prio THEN 0 ELSE 1 END AS grp, j, 0 AS kind, 0 AS pl, clean AS t FROM f WHERE length(clean) >= CASE WHEN ctx THEN 3 ELSE 4 END
  UNION ALL SELECT doc_id, CASE WHEN prio THEN 0 ELSE 1 END, j, n, p, array_to_string(own[p : p + n - 1], ' ')
    FROM (SELECT *, unnest(range(1, len(own) - n + 2)) AS p FROM f, (VALUES (1), (2), (3)) v(n) WHERE len(own) >= n)
  UNION ALL SELECT doc_id, 2, j, 0, 0, a[-1] || ' ' || b[1] FROM g WHERE len(a) > 0 AND len(b) > 0
  UNION ALL SELECT doc_id, 2, j, 1, 0, a[-2] || ' ' || a[-1] || ' ' || b[1] FROM g WHERE len(a) > 1 AND len(b) > 0
  UNION ALL SELECT doc_id, 2, j, 2, 0, a[-1] || ' ' || b[1] || ' ' || b[2] FROM g WHERE len(a) > 0 AND len(b) > 1
  UNION ALL SELECT doc_id, 3, j, 0, 0, a[-1] || ' ' || b[1] || ' ' || c[1] FROM g WHERE len(a) > 0 AND len(b) > 0 AND len(c) > 0
), o AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY grp, j, kind, pl) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY grp, j, kind, pl) AS u FROM r) WHERE u = 1)
SELECT doc_id, n - 1 AS pos, t AS candidate FROM o WHERE n <= 40"""


@query(f"WITH texts AS (SELECT doc_id, text FROM documents), {_CANDIDATES}")
def ngram_candidates(spark, d):
    out = mining.candidates_of(table(spark, d, "documents"), "doc_id", "text")
    return out.withColumn("pos", F.col("pos").cast("bigint"))


_LABELS = "'Net contents ' || p_size || chr(10) || 'ACTIVE INGREDIENTS:' || chr(10) || upper(p_name) || chr(10) || 'of 75% wt.' || chr(10) || p_name || chr(10) || p_type || ' ' || p_brand"


@query(f"WITH texts AS (SELECT p_partkey AS doc_id, {_LABELS} AS text FROM part), {_CANDIDATES}")
def label_candidates(spark, d):
    """Candidates of texts that have the ingredients' section."""
    p, line = table(spark, d, "part"), F.lit("\n")
    text = F.concat(F.lit("Net contents "), "p_size", line, F.lit("ACTIVE INGREDIENTS:"), line, F.upper("p_name"), line, F.lit("of 75% wt."), line, "p_name", line, "p_type", F.lit(" "), "p_brand")
    out = mining.candidates_of(p.select(F.col("p_partkey").alias("doc_id"), text.alias("text")), "doc_id", "text")
    return out.withColumn("pos", F.col("pos").cast("bigint"))


_GS1 = "'(01)' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '(10) ' || p_brand || '(30)' || p_size"
_FIELD = "nullif(trim(regexp_extract(code, '\\({0}\\)([^(]*)', 1)), '') AS {1}"


@query(f"SELECT p_partkey, {', '.join(_FIELD.format(k, v) for k, v in T.GS1.items())} FROM (SELECT p_partkey, {_GS1} AS code FROM part)")
def gs1_parse(spark, d):
    code = F.concat(F.lit("(01)"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit("(10) "), F.col("p_brand"), F.lit("(30)"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", *[T.gs1_field(code, x).alias(x) for x in ("gtin", "batch", "serial", "count")])


@query(
    f"""WITH c AS (SELECT p_partkey, {_DERIVED.format("p_partkey")} AS good FROM part), t AS (
  SELECT p_partkey, CASE WHEN regexp_matches(good, '[05]') THEN [] ELSE [good] END || [good] || CASE WHEN contains(good, '5') THEN [replace(good, '5', '3')] ELSE [] END AS xs FROM c
), u AS (SELECT p_partkey, unnest(xs) AS cas, unnest(range(len(xs))) AS i FROM t)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS pos, cas FROM (SELECT p_partkey, cas, min(i) AS i FROM u GROUP BY ALL) WHERE cas[1] <> '0'"""
)
def digit_confusion_repair(spark, d):
    text = F.concat(F.lit("CAS "), F.translate(derived_cas(F.col("p_partkey")), "05", "OS"), F.lit("\nBatch "), derived_cas(F.col("p_partkey")))
    out = mining.identifiers_of(table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@query("SELECT p_partkey, sha256(p_name || '|' || p_brand || '|' || p_type) AS fingerprint FROM part")
def fingerprint(spark, d):
    return table(spark, d, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_name", "p_brand", "p_type"), 256).alias("fingerprint"))


@query(
    """WITH a AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'a' ELSE 'b' END AS side, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS n
FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"""
)
def parity_except(spark, d):
    return R.parity(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query(
    """SELECT coalesce(a.k, b.k) AS k, a.f AS a, b.f AS b, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' WHEN a.f IS NOT DISTINCT FROM b.f THEN 'same' ELSE 'changed' END AS class
FROM (SELECT s_suppkey * 2 AS k, s_nationkey AS f FROM supplier) a FULL JOIN (SELECT c_custkey AS k, c_nationkey AS f FROM customer) b ON a.k = b.k"""
)
def set_compare(spark, d):
    a = table(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("k"), F.col("s_nationkey").alias("f"))
    return R.register_diff(a, table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("f")), "k", "f")


@query("SELECT n_nationkey, 'Nation NATION_' || n_nationkey || ' of region ' || n_regionkey AS text FROM nation")
def i18n_template(spark, d):
    text = T.translated(F.lit("Nation {name} of region {region}"), {"name": F.col("n_name"), "region": F.col("n_regionkey")})
    return table(spark, d, "nation").select("n_nationkey", text.alias("text"))


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def multiset_difference(spark, d):
    return R.multiset_difference(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN p_size + 250 + 0.3 * least(p_retailprice, 100) WHEN p_size < 20 THEN p_size + 200 + 0.3 * least(p_retailprice, 100) ELSE p_size + 0.3 * least(p_retailprice, 100) END AS score FROM part")
def pass_score(spark, d):
    s = T.pass_score(F.col("p_size"), F.col("p_size") < 10, F.col("p_size") < 20, F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", s.alias("score"))
