"""More named queries with SQL: what results show, checks of registers and dictionaries, reads of labels.

Importing this module registers them in the catalog.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _DERIVED, _HITS, _SUM_OK, NO_CAS, SOURCES, asked, derived_cas, query, register, table
from .functions import display as S
from .functions import text as T
from .operators import mining, search, usage
from .plans import registers as R
from .sources import registers as sources

_MAP = lambda d: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"

#: Codes for part types, as a dictionary of two sections: section b's are another guide's.
CODES = [("a", "ECONOMY", "cheap", False), ("a", "SMALL", "little", False), ("a", "Brand#11", "first", True), ("a", "PROMO", "offer", True)]
_CODES = ", ".join(f"('{s}', '{c}', '{m}', {str(t).lower()})" for s, c, m, t in CODES)


@query(
    f"""WITH codes(section, code, meaning, transferred) AS (VALUES {_CODES}), c AS (SELECT p_partkey AS id, p_type || '/' || p_brand AS cell FROM part),
p AS (SELECT id, cell, unnest(string_split(cell, '/')) AS part, unnest(range(len(string_split(cell, '/')))) AS i FROM c)
SELECT id, cell, string_agg(coalesce(meaning, part || ': {S.UNKNOWN.replace("'", "''")}'), ' + ' ORDER BY i) AS title,
  CASE WHEN bool_or(coalesce(transferred, false)) THEN 'after another guide' ELSE '' END AS attribution
FROM p LEFT JOIN codes ON lower(part) = lower(code) GROUP BY id, cell"""
)
def code_titles(spark, d):
    codes = spark.createDataFrame(CODES, "section string, code string, meaning string, transferred boolean")
    cells = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("a").alias("section"), F.concat("p_type", F.lit("/"), "p_brand").alias("cell"))
    return S.code_titles(cells, codes, (), {"a": "after another guide"}).select("id", "cell", "title", "attribution")


_FOLDED = {"i": "Insecticide", "f": "Fungicide", "r": "Rodenticide", "n": "Nematicide", "a": "Acaricide", "h": "Herbicide", "m": "Molluscicide", "v": "Viruses / Microbials", "sph": "Sex Pheromone", "pgr": "Plant Growth Regulator", "rep": "Repellent"}


@query(
    f"""WITH c AS (SELECT n_nationkey AS id, substr(n_name, 1, 1) || ', ' || chr(97 + n_nationkey) || '+S.Ph' AS cell FROM nation),
p AS (SELECT id, trim(unnest(regexp_split_to_array(cell, '[+,]'))) AS code, unnest(range(3)) AS i FROM c)
SELECT id, string_agg(code || '=' || coalesce({_MAP(_FOLDED)}[lower(replace(code, '.', ''))], '?'), '|' ORDER BY i) AS codes FROM p GROUP BY id"""
)
def described_codes(spark, d):
    n = table(spark, d, "nation")
    cell = F.concat(F.substring("n_name", 1, 1), F.lit(", "), F.chr(F.lit(97) + F.col("n_nationkey")), F.lit("+S.Ph"))
    parts = F.transform(S.described(cell), lambda x: F.concat(x["code"], F.lit("="), F.when(x["unknown"], "?").otherwise(x["meaning"])))
    return n.select(F.col("n_nationkey").alias("id"), F.array_join(parts, "|").alias("codes"))


EXPLAINED = {"F": "finished", "O": "open", "REV": "under review", "REV*": "see the note"}


@query(
    """SELECT o_orderkey, CASE s WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'REV*' THEN 'see the note under review asterisk' ELSE '' END AS lines,
  CASE WHEN s = 'REV*' THEN 'decree (REV*)' ELSE 'decree: ' || s END AS shown
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'REV*' ELSE o_orderstatus END AS s FROM orders)"""
)
def status_explained(spark, d):
    s = F.when(F.col("o_orderstatus") == "P", "REV*").otherwise(F.col("o_orderstatus"))
    phrase = F.when(s == "REV*", "decree").otherwise(F.concat(F.lit("decree: "), s))
    return table(spark, d, "orders").select(
        "o_orderkey", F.array_join(S.status_lines(s, EXPLAINED, "asterisk"), " ").alias("lines"), S.status_text(F.lit("500.x"), phrase, s, False).alias("shown")
    )


@query(
    f"""SELECT p_partkey, coalesce({_MAP(S.LABELS)}[k], k) AS label, coalesce({_MAP(S.NOTICES)}[k], '') AS notice,
  CASE WHEN p_size > 25 THEN p_container ELSE k END AS version
FROM (SELECT *, ([{", ".join(f"'{x}'" for x in (*SOURCES, "other"))}])[p_partkey % 8 + 1] AS k, p_type AS p_container FROM part)"""
)
def source_facts(spark, d):
    k = F.element_at(F.array(*map(F.lit, (*SOURCES, "other"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    built = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.lit(""))
    return table(spark, d, "part").select("p_partkey", S.source_label(k).alias("label"), S.source_notice(k).alias("notice"), S.data_version(built, k).alias("version"))


@query(
    f"""SELECT p_partkey, CASE WHEN fixed THEN p_brand ELSE cas END AS raw, CASE WHEN fixed THEN cas ELSE '' END AS corrected, CASE WHEN fixed THEN 'master' ELSE '' END AS source,
  p_type || '|' || p_brand AS suggested
FROM (SELECT *, p_size > 25 AS fixed, {_DERIVED.format("p_partkey")} AS cas FROM part)"""
)
def correction_fields(spark, d):
    fixed, none = F.col("p_size") > 25, F.lit(None).cast("string")
    rows = table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit(" "), derived_cas(F.col("p_partkey"))).alias("cas"), F.when(fixed, derived_cas(F.col("p_partkey"))).alias("cas_corrected"),
        F.concat("p_brand", F.lit("  ")).alias("cas_raw"), F.lit("master").alias("cas_source"), F.array("p_type", F.lit(" "), F.concat(F.lit(" "), "p_brand")).alias("cas_suggested"),
        *[none.alias(c) for c in ("cas_stereo", "cas_flag", "cas_review", "cas_note", "duplicate_note")],
    )
    c = S.corrections()
    return rows.select("p_partkey", c["raw"].alias("raw"), c["corrected"].alias("corrected"), c["source"].alias("source"), F.array_join(c["suggested"], "|").alias("suggested"))


@query(f"SELECT p_partkey, cas || CASE WHEN {_SUM_OK} THEN '' ELSE '!' END AS shown FROM (SELECT p_partkey, {_DERIVED.format('p_partkey')} AS cas FROM part)")
def shown_identifiers(spark, d):
    marked = F.transform(S.shown_identifiers(F.concat(F.lit("CAS: "), derived_cas(F.col("p_partkey")))), lambda x: F.concat(x["cas"], F.when(x["wrong"], "!").otherwise("")))
    return table(spark, d, "part").select("p_partkey", F.array_join(marked, " ").alias("shown"))


@query(
    """SELECT p_partkey, CASE WHEN regexp_matches(c, '^\\d{2,7}-\\d{2}-\\d$') OR regexp_matches(c, '^\\d{5,9}-\\d$') THEN c ELSE '' END AS cas,
  CASE WHEN regexp_matches(c, '^\\d{2,7}-\\d{2}-\\d$') THEN replace(c, '-', '') ELSE '' END AS digits
FROM (SELECT p_partkey, (p_partkey % 3 * 50000 + p_size * 7) || CASE WHEN p_size % 2 = 0 THEN '-12' ELSE '' END || '-' || p_size % 10 AS c FROM part)"""
)
def csv_identifiers(spark, d):
    c = F.concat((F.col("p_partkey") % 3 * 50000 + F.col("p_size") * 7).cast("string"), F.when(F.col("p_size") % 2 == 0, "-12").otherwise(""), F.lit("-"), (F.col("p_size") % 10).cast("string"))
    return table(spark, d, "part").select("p_partkey", S.cas_of_csv(F.concat(F.lit(" "), c)).alias("cas"), S.cas_digits(c).alias("digits"))


@query("SELECT s_suppkey, substr(regexp_replace(regexp_replace(s_name || ' & ' || s_suppkey || '!', '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug FROM supplier")
def report_slug(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", S.slug(F.concat("s_name", F.lit(" & "), "s_suppkey", F.lit("!"))).alias("slug"))


TEXTS = {"ar": {"F": "ar-F", "O": "ar-O"}, "en": {"F": "en-F"}}


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'en-F' ELSE 'none' END ELSE CASE o_orderstatus WHEN 'F' THEN 'ar-F' WHEN 'O' THEN 'ar-O' ELSE 'none' END END AS text
FROM orders"""
)
def message_texts(spark, d):
    language = F.element_at(F.array(F.lit("en"), F.lit("ar"), F.lit("fr")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", S.message(F.col("o_orderstatus"), language, TEXTS, F.lit("none")).alias("text"))


@query("SELECT p_type AS section, p_brand AS code, count(*) AS n FROM part WHERE p_brand NOT IN (SELECT 'Brand#' || n_nationkey FROM nation) GROUP BY ALL")
def uncovered_codes(spark, d):
    p, nations = table(spark, d, "part"), table(spark, d, "nation")
    codes = p.select(F.col("p_type").alias("section")).distinct().join(nations.select(F.concat(F.lit("brand# "), "n_nationkey").alias("code")))
    return R.uncovered(p.select(F.col("p_type").alias("section"), F.col("p_brand").alias("code")), codes)


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') GROUP BY ALL")
def outside_vocabulary(spark, d):
    return R.outside_vocabulary(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", {"1-URGENT": ["F", "O"], "2-HIGH": ["F"]})


@query(
    f"""SELECT count(*) AS rows, count(DISTINCT p_name) AS keys, count(*) - count(DISTINCT p_name) AS duplicates, count(*) FILTER (WHERE cas = '') AS without_cas, count(*) FILTER (WHERE cas = 'see remark') AS odd_cas
FROM (SELECT p_name, CASE WHEN p_partkey % 11 = 0 THEN 'see remark' WHEN p_partkey % 7 = 6 THEN '' ELSE {_DERIVED.format("p_partkey")} END AS cas FROM part)"""
)
def ingest_counters(spark, d):
    return R.ingest_counters(register(spark, d), "name", "cas")


_STATES = [("libya-248", "ready", 5), ("libya-500", "failed", 7), ("eu", "ready", 0), ("epa", "ready", 9)]
_STATE_SQL = f"states(source_key, state, rows) AS (VALUES {', '.join(map(str, _STATES))})"


@query(f"WITH {_STATE_SQL} SELECT count(*) AS sources, count(*) FILTER (WHERE state = 'ready') AS ready, CAST(sum(rows) FILTER (WHERE state = 'ready') AS BIGINT) AS rows FROM states")
def source_totals(spark, d):
    return search.totals(spark.createDataFrame(_STATES, "source_key string, state string, rows long"))


@query(f"WITH {_HITS}, {_STATE_SQL} SELECT row_id, source_key FROM reg WHERE source_key IN (SELECT source_key FROM states WHERE state = 'ready' AND rows > 0)")
def available_sources(spark, d):
    return search.available(register(spark, d), spark.createDataFrame(_STATES, "source_key string, state string, rows long")).select("row_id", "source_key")


@query("SELECT l_orderkey, l_linenumber, a.n_name AS a_name, b.n_name AS b_name, a.n_name IS NOT NULL AND b.n_name IS NOT NULL AS found FROM lineitem LEFT JOIN nation a ON a.n_nationkey = l_suppkey LEFT JOIN nation b ON b.n_nationkey = l_linenumber * 5")
def pair_rows(spark, d):
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("n").alias("a_source"), F.col("l_suppkey").alias("a_row"), F.lit("n").alias("b_source"), (F.col("l_linenumber") * 5).cast("bigint").alias("b_row"))
    reg = table(spark, d, "nation").select(F.lit("n").alias("source_key"), F.col("n_nationkey").cast("bigint").alias("row"), F.col("n_name").alias("name"), F.lit("").alias("cas"))
    return R.pair_rows(pairs, reg).select("l_orderkey", "l_linenumber", "a_name", "b_name", "found")


@query("SELECT o_orderkey AS k, o_custkey AS expected, p_partkey AS actual, CASE WHEN p_partkey IS NULL THEN 'missing' ELSE 'differs' END AS class FROM orders LEFT JOIN part ON o_orderkey = p_partkey WHERE p_partkey IS NULL OR p_partkey <> o_custkey")
def expected_against(spark, d):
    gold = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    return R.expected_against(table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").alias("v")), gold, "k", "v")


@query()
def file_fingerprints(spark, d):
    """SHA-256 of the bytes of a table's files, tested against the files themselves."""
    return sources.fingerprints(spark, f"{d}/nation.parquet").select("length", "sha256")


# Reads of labels: conversations are reads, their turns the passes of a read.


def _passes(spark, d):
    words = lambda c: F.array_distinct(F.filter(F.transform(F.split(c, "[ \\t\\n\\r]+"), lambda x: F.regexp_replace(F.lower(x), "[^a-z]", "")), lambda x: F.length(x) >= 9))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("read_id"), F.col("turn").alias("pass"), T.cas_numbers(F.col("text")).alias("cas"), words("text").alias("names"))


_FUSED = """SELECT read_id, string_agg(x, '|' ORDER BY p, x) AS names FROM (
  SELECT read_id, x, min(turn * 100000 + i) AS p FROM (
    SELECT conv_id AS read_id, turn, unnest(ws) AS x, unnest(range(len(ws))) AS i
    FROM (SELECT conv_id, turn, list_filter([regexp_replace(lower(x), '[^a-z]', '', 'g') FOR x IN regexp_split_to_array(text, '[ \\t\\n\\r]+')], lambda x: length(x) >= 9) AS ws FROM conversations)
  ) GROUP BY read_id, x
) GROUP BY read_id"""


@query(f"WITH f AS ({_FUSED}) SELECT DISTINCT conv_id AS read_id, coalesce(names, '') AS names FROM conversations LEFT JOIN f ON conv_id = read_id")
def fused_passes(spark, d):
    return mining.fused(_passes(spark, d)).select("read_id", F.array_join("names", "|").alias("names"))


@query(
    """WITH p AS (SELECT conv_id, turn, CASE WHEN length(text) % 7 = 0 THEN 1 ELSE 0 END AS exact, length(text) % 101 AS best, length(text) % 90 AS conf FROM conversations),
m AS (SELECT * FROM p JOIN (SELECT conv_id, min(turn) FILTER (WHERE exact = 1) AS stop FROM p GROUP BY conv_id) s USING (conv_id) WHERE stop IS NULL OR turn <= stop),
s AS (SELECT conv_id, turn, best + CASE WHEN exact = 1 THEN 200 WHEN best >= 96 THEN 150 WHEN best >= 90 THEN 100 WHEN best >= 80 THEN 50 ELSE 0 END + least(conf, 100) * 0.3 AS score FROM m)
SELECT conv_id AS read_id, turn AS pass, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS n FROM s) WHERE n = 1"""
)
def best_passes(spark, d):
    n = F.length("text")
    passes = table(spark, d, "conversations").select(
        F.col("conv_id").alias("read_id"), F.col("turn").alias("pass"), (n % 101).alias("best"), F.lit(False).alias("exact_cas"), (n % 7 == 0).alias("exact_name"), (n % 90).alias("conf")
    )
    return mining.best_pass(passes).select("read_id", "pass", F.col("score").cast("double").alias("score"))


_READS = [(1, ["1001-01-1", "1001-02-2"], ["cold widget", "blue ring"]), (2, [], ["hot gears", "nothing like it"]), (3, [], [])]
_VIAS = ", ".join(f"({r}, '{x}', {str(mode).lower()})" for r, cas, names in _READS for mode, xs in ((True, cas), (False, names)) for x in xs)


def _reads(spark):
    return spark.createDataFrame(_READS, "read_id long, cas array<string>, names array<string>")


_READ_HITS = _HITS[: _HITS.index(", asked(qid, q)")] + f""", via(read_id, q, pro) AS (VALUES {_VIAS}),
asked AS (SELECT row_number() OVER (ORDER BY q) AS qid, q FROM (SELECT DISTINCT q FROM via))""" + _HITS[_HITS.index(", k AS (") :]


@query(
    f"""WITH {_READ_HITS}, h AS (SELECT via.read_id, hits.* FROM via JOIN asked USING (q) JOIN hits USING (qid)), s AS (
  SELECT read_id, max(v) AS best, bool_or(decisive) AS exact_name, bool_or(type = 'cas') AS exact_cas, arg_min(name, -v * 1000000 + row_id) AS name FROM h GROUP BY read_id
) SELECT CAST(x.read_id AS BIGINT) AS read_id, coalesce(best, 0) AS best, coalesce(exact_name, false) AS exact_name, coalesce(exact_cas, false) AS exact_cas, name FROM (VALUES (1), (2), (3)) x(read_id) LEFT JOIN s USING (read_id)"""
)
def read_scores(spark, d):
    return search.read_scores(_reads(spark), register(spark, d))


@query(
    f"""WITH {_READ_HITS}, h AS (SELECT via.read_id, hits.* FROM via JOIN asked USING (q) JOIN hits USING (qid) WHERE NOT pro),
b AS (SELECT read_id, row_id, max(v) AS v, any_value(source_key) AS source_key, any_value(source_ordinal) AS source_ordinal FROM h GROUP BY read_id, row_id)
SELECT CAST(read_id AS BIGINT) AS read_id, row_id, v, pos FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY
  CASE source_key WHEN 'libya-248' THEN 0 WHEN 'libya-500' THEN 1 WHEN 'eu' THEN 2 WHEN 'epa' THEN 3 ELSE 99 END, v DESC, source_ordinal, row_id) AS pos FROM b) WHERE pos <= 24"""
)
def search_candidates(spark, d):
    out = search.search_candidates(_reads(spark), register(spark, d), "farmer", NO_CAS)
    return out.select("read_id", "row_id", "v", F.col("pos").cast("bigint").alias("pos"))


_VISIBLE = "length(regexp_replace(coalesce(text, ''), '\\s', '', 'g'))"


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'exempt_cas' WHEN r < 0.6 THEN 'rejected_latin' WHEN doc_id % 100 < 45 THEN 'rejected_conf' ELSE 'passed' END AS gate, n < 6 OR doc_id % 100 < 40 AS weak
FROM (SELECT doc_id, {_VISIBLE} AS n, CASE WHEN {_VISIBLE} = 0 THEN 1.0 ELSE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / {_VISIBLE}::DOUBLE END AS r FROM documents)"""
)
def read_gates(spark, d):
    cas = F.when(F.col("doc_id") % 10 == 0, F.array(F.lit("1071-83-6"))).otherwise(F.array().cast("array<string>"))
    conf = F.col("doc_id") % 100
    return table(spark, d, "documents").select("doc_id", mining.gate_result(F.col("text"), cas, conf).alias("gate"), mining.weak_read(F.col("text"), conf).alias("weak"))


@query(
    """SELECT p_partkey, CASE WHEN p_size < 40 AND p_partkey % 2 = 0 AND p_partkey % 3 > 0 AND p_partkey % 5 > 0 THEN '' ELSE p_name END AS names FROM part"""
)
def gated_names(spark, d):
    names = F.array(F.lit("Active Ingredients"), "p_name", F.lit(" ingredient"))
    cas = F.when(F.col("p_partkey") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("50-00-0")))
    kept = mining.gated_names(names, F.col("p_size"), cas, F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 5 > 0)
    return table(spark, d, "part").select("p_partkey", F.array_join(kept, "|").alias("names"))


@query("SELECT p_partkey, p_size % 4 < 3 AS header FROM part")
def header_words(spark, d):
    word = F.element_at(F.array(F.lit("ACTVE"), F.lit("ingredints"), F.lit("Ingredient:"), F.lit("a widget")), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", mining.header_word(word).alias("header"))


@query("SELECT user_id, event_id FROM (SELECT *, max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS g FROM events) WHERE CAST(ts AS DATE) = g")
def latest_results(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return mining.latest(e, "user_id", "day").select("user_id", "event_id")


@query(f"WITH {_HITS} SELECT qid, row_id, v, type FROM hits")
def direct_scores(spark, d):
    return search.direct_scores(asked(spark), register(spark, d))


@query(f"WITH {_HITS} SELECT qid, row_id, v FROM hits ORDER BY v DESC, qid, row_id LIMIT 250")
def report_sample(spark, d):
    from .catalog import found

    return search.report(found(spark, d), 250).select("qid", "row_id", "v")


@query("SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS row FROM part")
def name_order(spark, d):
    """Rows numbered by name whatever its case (the declared choice: lower case by code points), then key."""
    rows = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("n"))
    return R.numbered(rows, "n", "p_partkey").select("p_partkey", "row")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'z' WHEN p_size % 3 = 1 THEN 'e|trans' ELSE '' END AS marks, p_name AS head
FROM part"""
)
def name_parts(spark, d):
    """Stereo marks and head names of names with brackets."""
    tail = F.element_at(F.array(F.lit("(Z)-(long group without marks)"), F.lit("(E)-trans"), F.lit("(none, really so)")), (F.col("p_size") % 3 + 1).cast("int"))
    name = F.concat("p_name", F.lit(" "), tail)
    return table(spark, d, "part").select("p_partkey", F.array_join(T.stereo_marks(name), "|").alias("marks"), T.head_name(name).alias("head"))


_GRADES = "CASE WHEN event_type = 'error' THEN 'HANG' WHEN event_type = 'purchase' THEN 'ACCEPT' WHEN event_type = 'view' THEN 'REJECT' ELSE 'EMPTY' END"


def _graded(spark, d):
    kind = F.col("event_type")
    cas = F.when(kind == "purchase", F.array(F.lit("50-00-0"))).otherwise(F.array().cast("array<string>"))
    e = table(spark, d, "events").select(
        F.col("event_id").alias("n"), F.when(kind == "error", "x").alias("error"), cas.alias("cas"), F.when(kind == "view", "text").alias("raw"),
        (F.col("user_id") % 50).alias("ms"), (F.col("event_id") % 4).alias("passes"),
    )
    return usage.graded(e)


@query(
    f"""SELECT count(*) AS reads, count(*) FILTER (WHERE g = 'ACCEPT') AS accept, count(*) FILTER (WHERE g = 'REJECT') AS reject, count(*) FILTER (WHERE g = 'EMPTY') AS empty,
  count(*) FILTER (WHERE g = 'HANG') AS hang, round(avg(user_id % 50), 6) AS mean_ms, max(user_id % 50) AS max_ms, round(avg(event_id % 4), 6) AS mean_passes FROM (SELECT *, {_GRADES} AS g FROM events)"""
)
def run_summary(spark, d):
    return usage.run_summary(_graded(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean_ms", "mean_passes")})


@query(
    f"""WITH r AS (SELECT event_id AS n, {_GRADES} AS g, user_id % 50 AS ms FROM events)
SELECT coalesce(a.n, b.n) AS n, a.g AS before, b.g AS after, CASE WHEN a.ms > 0 THEN CAST(floor(100.0 * (b.ms - a.ms) / a.ms + 0.5) AS BIGINT) END AS delta
FROM r a FULL JOIN (SELECT n + 1 AS n, g, ms FROM r) b ON a.n = b.n"""
)
def run_changes(spark, d):
    r = _graded(spark, d).select("n", "grade", "ms")
    return usage.run_changes(r, r.withColumn("n", F.col("n") + 1))


@query(
    """SELECT 'n' || n_nationkey AS node_id FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)"""
)
def leaf_nodes(spark, d):
    name = lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    nodes = table(spark, d, "nation").select(F.lit(1).alias("read_id"), name("n", "n_nationkey").alias("node_id"), name("r", "n_regionkey").alias("parent_id"))
    roots = table(spark, d, "region").select(F.lit(1).alias("read_id"), name("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"))
    return mining.leaf_nodes(nodes.union(roots)).select("node_id")
