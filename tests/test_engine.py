"""Functions and operators against published expectations, and against a row-at-a-time model."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from registra import catalog
from registra.functions import text as T
from registra.operators import decisions as D
from registra.operators import mining, search, usage
from registra.plans import fuzzy
from registra.plans import registers as R


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("cas", "ok"), [("1071-83-6", True), ("1071-85-6", False), ("1071-83-7", False), ("12", None), (None, None)])
def test_checksum(spark, cas, ok):
    assert one(spark, T.cas_checksum(F.lit(cas).cast("string"))) is ok


def test_norm(spark):
    got = [one(spark, T.norm(F.lit(x).cast("string"))) for x in ("Café  (X)", "إبـرَة", None, "a b", "N,N-Di")]
    assert got == ["cafe x", "ابره", "", "a b", "n n-di"]
    assert one(spark, T.norm(F.lit("ﬁx ½"), exact=True)) == "fix 1 2"


@pytest.mark.parametrize(
    ("q", "s", "verdict"),
    [("glphosate", "glyphosate", "probable"), ("permethrin", "cypermethrin", "similar"), ("metalaxyl", "metalaxyl-m", "similar"),
     ("2,4-d", "2,4-db", "similar"), ("abc", "abd", None), ("", "x", None), ("same", "same", "exact"), ("x (e)-abcd", "x (z)-abcd", "similar")],
)
def test_judge_name(spark, q, s, verdict):
    assert one(spark, T.judge_name(F.lit(q), F.lit(s))) == verdict


def test_cells(spark):
    cells = T.parse_cas_cell(F.lit("see 107 1-83 -6 and 133-06-02"))
    assert [x.cas.replace(" ", "") for x in one(spark, cells)] == ["1071-83-6", "133-06-0"]
    assert one(spark, T.cas_numbers(F.lit("12345678-12-3 [50-00-0]"))) == ["2345678-12-3", "50-00-0"]
    assert [one(spark, T.cas_cell_is_empty(F.lit(x))) for x in ("", "See note", "n/a", "50-00-0", "12")] == [True, True, True, False, False]


def test_scores(spark):
    assert one(spark, T.pooled_confidence(F.lit(100), F.lit(999))) == 1200
    none = F.array().cast("array<string>")
    reason = lambda text, conf, cas=none: one(spark, T.rejected_reason(F.lit(text), cas, F.lit(conf)))
    assert (reason("abc", 44), reason("abc", 45), reason("ابجد", 90), reason("ابجد", 9, F.array(F.lit("1071-83-6")))) == ("conf", None, "mixed", None)
    assert one(spark, T.gs1_field(F.lit("(01)123(10) a b(99)z"), "batch")) == "a b"
    assert one(spark, T.gs1_field(F.lit("01123"), "gtin")) is None


def picked(spark, column, texts):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k long, text string")
    return [x.x for x in df.select("k", column("text").alias("x")).orderBy("k").collect()]


def test_identifiers(spark):
    texts = ["CAS 1O71-83-6", "Batch 1071-83-6\nLot 5 1071-83-6\nPlot 5 CAS 50-00-0", "", None, "8atch 1071-83-6", "Reg No 50-00-0\r\nCAS No 50-00-0 and 64 - 17 - 5",
             "no 50-00-0", "Regg. No: 50-00-0", "l07l-83-6, 1071-83-6 x1071-83-6", "BIG-50-00-0", "00-00-0"]
    want = [["1071-83-6"], ["50-00-0", "30-00-0"], [], [], [], ["50-00-0", "64-17-5", "30-00-0", "64-17-3"], ["50-00-0", "30-00-0"], [], ["1071-83-6"], ["50-00-0", "30-00-0"], []]
    assert picked(spark, mining.extract_identifiers, texts) == want


def test_identifiers_of_letters_alone(spark):
    texts = ["CAS SOOO-OO-O", "SO - OO - O", "lO7l-BZ-G", "Batch SO-OO-O", "SO-OO-O lot 50-00-0", "no hyphen SOOOOO"]
    want = [["5000-00-0", "3000-00-0"], ["50-00-0", "30-00-0"], ["1071-82-6"], [], ["50-00-0", "30-00-0"], []]
    assert picked(spark, mining.extract_identifiers, texts) == want


def test_digit_confusion_repair_of_large_keys(spark, tmp_path):
    """Keys whose derived identifiers have no digits but 0 and 5, which the query's texts print as O and S."""
    spark.range(399999, 400007).toDF("p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(catalog.oracle_sql()["digit_confusion_repair"]).fetchall()
    got = [tuple(x) for x in catalog.digit_confusion_repair(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and (400000, 0, "5000-00-0") in got


def test_candidates(spark):
    texts = ["GROUND\nALUMINIUM\nSULPHATE", None, "", "\n".join(f"word{c} other{c} third{c}" for c in "abcdefghijklmnop"),
             "Safety first\nActive Ingredient\n2,4-D acid 75%\nOil wt.\nwater\nOil wt."]
    got = picked(spark, mining.extract_candidates, texts)
    assert got[0] == ["GROUND", "ALUMINIUM", "SULPHATE", "GROUND ALUMINIUM", "ALUMINIUM SULPHATE", "GROUND ALUMINIUM SULPHATE"]
    assert got[1:3] == [[], []] and len(got[3]) == 40
    assert got[4][:7] == ["Active Ingredient", "Active", "Ingredient", "2 4-D acid 75", "acid", "Oil wt.", "Oil"]
    assert got[4].index("Safety first") > got[4].index("Oil") and "acid Oil" in got[4]
    plain = picked(spark, lambda c: mining.extract_candidates(c, filter_junk=True), ["Danger poison\nzinc oxide"])
    assert plain == [["zinc oxide", "zinc", "oxide"]]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_blocking_loses_nothing(spark):
    rng = random.Random(3)
    names = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 16))) for _ in range(150)}
    df = spark.createDataFrame([(x,) for x in names], "l string")
    for ratio in (0.172, 0.205, 0.28):
        pairs = fuzzy.near_pairs(df.select("l", F.col("l").alias("s")), df.select(F.col("l").alias("r"), F.col("l").alias("t")), ratio)
        got = {(x.l, x.r) for x in pairs.collect()}
        want = {(a, b) for a in names for b in names if distance(a, b) <= ratio * max(len(a), len(b))}
        assert want <= got


REGISTER = "row_id long, source_key string, source_ordinal long, row long, name string, cas string, status string, pc_code string"


def model(q, name, cas):
    """Score of one row, step by step."""
    import re
    import unicodedata

    def norm(s):
        s = "".join(c for c in unicodedata.normalize("NFKD", s or "") if not 0x300 <= ord(c) <= 0x36F).lower()
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s./-]|_", " ", s)).strip()

    compact = lambda s: re.sub(r"[\s./-]", "", s)
    half = lambda x: int(x + 0.5 // 1)
    nq, best = norm(q), (0, "")
    numbers = re.findall(r"\d{2,7}-\d{2}-\d", cas or "")
    if re.fullmatch(r"\d{2,7}-\d{2}-\d", q.strip()) and numbers:
        return (100, "cas") if q.strip() in numbers else None
    for kind, x in (("name", name), ("cas", cas)):
        if not x:
            continue
        n = norm(x)
        if n == nq and (kind == "name" or best[0] < 100):
            best = (100, "name")
            if kind == "name":
                break
            continue
        ratio = min(len(n), len(nq)) / max(len(n), len(nq), 1)
        if min(len(n), len(nq)) >= 4 and (n in nq or nq in n) and ratio >= 0.72 and ratio * 96 > best[0]:
            best = (half(ratio * 96 + 0.5), "partial")
        m = max(len(compact(n)), len(compact(nq)))
        if m and (v := 100 - distance(compact(nq), compact(n)) / m * 100) > best[0]:
            best = (half(v + 0.5), "similar")
    return best if best[0] >= 80 else None


def test_search_model(spark):
    rng = random.Random(11)
    base = ["glyphosate", "glyphosate sodium", "2,4-D ester", "Métalaxyl-M", "carbo furan", "carbofuran", "a.b/c-d", "zinc", "zinc oxide"]
    names = base + ["".join(c if rng.random() > 0.1 else rng.choice("aeo ") for c in rng.choice(base)) for _ in range(60)]
    cells = ["1071-83-6", "see remark", "", None, "50-00-0\n[1071-83-6]", "none"]
    rows = [(k, rng.choice(["eu", "epa", "canada"]), k % 3, k, n, rng.choice(cells), "ok", "1") for k, n in enumerate(names)]
    asked = [(1, "glyphosate"), (2, "1071-83-6"), (3, "carbofurans"), (4, "see remark"), (5, "zinc oxid"), (6, "metalaxyl m"), (7, ""), (8, "50-00-1")]
    hits = search.hits(spark.createDataFrame(asked, "qid long, q string"), spark.createDataFrame(rows, REGISTER))
    got = {(x.qid, x.row_id): (x.v, x.type) for x in hits.collect()}
    want = {(i, r[0]): s for i, q in asked for r in rows if (s := model(q, r[4], r[5]))}
    assert got == want
    direct = search.direct_scores(spark.createDataFrame(asked, "qid long, q string"), spark.createDataFrame([r for r in rows if r[5] != cells[4]], REGISTER))
    assert {(x.qid, x.row_id): x.v for x in direct.collect()} == {(i, r[0]): s[0] for i, q in asked for r in rows if r[5] != cells[4] and (s := model(q, r[4], r[5]))}
    top = search.ranked(hits, 3).collect()
    assert all(x.pos <= 3 for x in top)


def hit(k, name, status="a", code="", v=100, row=0, decisive=True, cas="", via=""):
    return (1, k, "eu", 0, row, name, cas, status, code, v, "name", name, decisive, False, k + 1, via)


HIT = REGISTER.replace("row_id", "qid long, row_id", 1) + ", v long, type string, field string, decisive boolean, candidate boolean, pos int, via string"


def test_collapse(spark):
    same = [hit(k, "captan", row=9 - k) for k in range(9)]
    got = D.collapse_to_decisive(spark.createDataFrame(same, HIT)).collect()
    assert [x.row for x in got] == [1]
    mixed = [hit(0, "captan"), hit(1, "captan", status="b"), hit(2, "folpet", decisive=False, v=90), hit(3, "thiram", decisive=False, v=88, via="other read")]
    got = D.collapse_to_decisive(spark.createDataFrame(mixed, HIT)).collect()
    assert sorted(x.row_id for x in got) == [0, 1, 3]


def test_votes(spark):
    reads = [(1, 0, ["50-00-0"], ["a"], 10), (1, 1, ["50-00-0"], [], 30), (1, 2, ["60-00-0"], ["a"], 99), (1, 3, [], ["a"], 5)]
    got = mining.votes(spark.createDataFrame(reads, "scan_id long, read long, cas array<string>, names array<string>, conf long")).collect()
    assert {x.read: (x.votes, x.place) for x in got} == {0: (3, 1), 3: (3, 2), 2: (2, 3), 1: (2, 4)}


def test_votes_of_whole_texts(spark, tmp_path):
    """Against brute force over all words and identifiers."""
    import re

    from registra import catalog

    rng = random.Random(5)
    vocabulary = [*(f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"), "captan", "Captanol,", "permethrin", "cypermethrin\n", "12", "50-00-0", "1071-83-6"]
    texts = [(s, r, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 9)))) for s in range(12) for r in range(6)]
    texts += [(99, 0, "see the first line captan"), (99, 1, "one two three captan"), (99, 2, "no four five 50-00-0"), (99, 3, "no four five 60-00-0")]
    spark.createDataFrame(texts, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def agree(a, b):
        x, y = ({*re.findall(r"\d{2,7}-\d{2}-\d", t)} for t in (a, b))
        if x and y:
            return bool(x & y)
        m, n = ({re.sub("[^a-z]", "", w.lower()) for w in t.split()} - {""} for t in (a, b))
        return bool(m & n) or any(len(v) >= 6 <= len(w) and (v in w or w in v) for v in m for w in n)

    got = {(x.scan_id, x.read): x.votes for x in catalog.queries()["frame_vote"](spark, str(tmp_path)).collect()}
    assert got == {(s, r): sum(s == z and (r == q or agree(t, u)) for z, q, u in texts) for s, r, t in texts}
    assert [got[99, r] for r in range(4)] == [2, 2, 1, 1]


def test_lines(spark):
    boxes = [(1, "b", 90.0, 50.0, 10.0, 60.0, 20.0), (1, "a", 90.0, 0.0, 12.0, 9.0, 21.0), (1, "c", 90.0, 0.0, 60.0, 9.0, 70.0), (1, "no", 10.0, 0.0, 60.0, 9.0, 70.0)]
    df = spark.createDataFrame(boxes, "read_id long, text string, conf double, x0 double, y0 double, x1 double, y1 double")
    assert [x.text for x in mining.regroup_lines(df).orderBy("line").collect()] == ["a b", "c"]


def test_numbering_with_other_columns(spark):
    """Numbers are right whatever else a row carries and however often a key occurs."""
    n = 400_000
    df = spark.range(n).select((F.xxhash64("id") % 1000).alias("x"), "id", F.repeat(F.lit("p"), 20).alias("pad")).withColumn("x", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("x")))
    out = R.numbered(df, "x", "id").cache()
    stats = out.agg(F.count_distinct("row"), F.min("row"), F.max("row")).first()
    assert tuple(stats) == (n, 1, n)
    from pyspark.sql.window import Window

    want = df.withColumn("row", F.row_number().over(Window.orderBy("x", "id"))).select("id", "row")
    assert out.select("id", "row").exceptAll(want.withColumn("row", F.col("row").cast("bigint"))).count() == 0
    only = R.numbered(df.select("x"), "x")
    assert only.agg(F.count_distinct("row")).first()[0] == n


def test_registers(spark):
    rows = spark.createDataFrame([(3, "x"), (1, "y"), (2, "z")], "k long, t string")
    assert [(x.k, x.row) for x in R.numbered(rows, "k").orderBy("row").collect()] == [(1, 1), (2, 2), (3, 3)]
    assert [tuple(x) for x in R.gaps(rows.filter("k <> 2"), "k").collect()] == [(2, 2)]
    far = spark.createDataFrame([(2,), (2,), (5,), (3_000_000_000,), (-4,), (None,)], "k long")
    assert sorted(tuple(x) for x in R.gaps(far, "k").collect()) == [(1, 1), (3, 4), (6, 2_999_999_999)]
    assert sorted(x.k for x in R.missing_numbers(far.filter("k < 9"), "k").collect()) == [1, 3, 4]
    assert R.gaps(far.limit(0), "k").count() == 0
    left = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    right = spark.createDataFrame([("a",), ("c",), (None,)], "k string")
    assert sorted(str(x.k) for x in R.multiset_difference(left, right, ["k"]).collect()) == ["None", "a", "b"]
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "c", None), (2, None, 5)], "k long, t string, o long")
    assert sorted((x.k, x.t) for x in R.first_wins(rows, ["k"], "o").collect()) == [(1, "c"), (2, None)]
    assert sorted((x.k, x.t) for x in R.last_wins(rows, ["k"], "o").collect()) == [(1, "b"), (2, None)]
    assert {x.t for x in R.longest_wins(rows.withColumn("t", F.repeat("t", 3)), ["k"], "t", "o").collect()} == {"ccc", None}
    faults = R.sequence_faults(spark.createDataFrame([(1, 1), (1, 2), (3, 3), (0, 4)], "n long, o long"), "n", "o")
    assert sorted((x.o, x.fault) for x in faults.collect()) == [(1, "repeated"), (2, "misplaced"), (2, "repeated"), (4, "misplaced"), (4, "nonpositive")]
    up = usage.upsert(spark.createDataFrame([(1, "old"), (2, "old")], "n long, v string"), spark.createDataFrame([(2, "new")], "n long, v string"), "n")
    assert sorted((x.n, x.v) for x in up.collect()) == [(1, "old"), (2, "new")]


def test_near_links(spark):
    """Counts without pairs against all pairs of rows, with repeated names and identifiers."""
    rng = random.Random(2)
    base = ["glyphosate", "glyphosat", "glyphosate x", "captan", "captans", "zineb", "carbofuran", "carbofurane"]
    rows = [(k, rng.choice(base), rng.choice(["50-00-0", "64-17-5", "", "see note"])) for k in range(60)] + [(90, None, "50-00-0"), (91, "", "")]
    df = spark.createDataFrame(rows, "id long, name string, cas string")
    got = {x.id: (x["class"], x.links) for x in D.near_links(df).collect()}
    pairs = [(x.a, x.b) for x in D.near_names(df).collect()]
    want = {k: sum(k in p for p in pairs) for k, n, _ in rows if n}
    assert {k: n for k, (_, n) in got.items()} == want and len(pairs) > 50
    names = {k: n for k, n, _ in rows if n}
    assert all(c == min(j for j, m in names.items() if m == names[k]) for k, (c, _) in got.items())


def test_verdicts(spark):
    """Index hits and search hits are judged, lines by themselves, heads before brackets too."""
    rows = [(0, "eu", 0, 0, "2,4-D ((2,4-dichlorophenoxy) acetic acid)", "94-75-7", "ok", "1"), (1, "eu", 0, 1, "glyphosate\nround up", "", "ok", "1"),
            (2, "epa", 1, 2, "glyphosatr", "", "ok", "1"), (3, "epa", 1, 3, "zineb", "", "ok", "1"), (4, "epa", 1, 4, "x (e)-abcdefgh", "", "ok", "1")]
    reg = spark.createDataFrame(rows, REGISTER)
    asked = spark.createDataFrame([(1, "2,4-D"), (2, "Glyphosate"), (3, "94-75-7"), (4, ""), (5, "x (z)-abcdefgh")], "qid long, q string")
    found = spark.createDataFrame([(2, 2), (2, 3), (3, 0), (5, 4), (2, 1)], "qid long, row_id long")
    got = {(x.qid, x.row_id): x.verdict for x in D.verdicts(asked, reg, found).collect()}
    assert got == {(1, 0): "exact", (2, 1): "exact", (2, 2): "probable", (5, 4): "similar"}


@pytest.mark.parametrize(("other", "shared"), [("cold anvil", True), ("COLD WIDGET", False)])
def test_match_kind_of_a_shared_number(spark, tmp_path, other, shared):
    """Both keys derive 1019-32-2. A number that several names have is told of a match of any kind but a candidate."""
    parts = [(1932, "cold widget", "b", 1), (919032, other, "b", 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {(x.qid, x.row_id): (x.kind, x.shared) for x in catalog.match_kind(spark, str(tmp_path)).collect()}
    assert (got[1, 1932], got[3, 1932]) == (("partial", shared), ("name", shared))


def test_reads(spark):
    """From passes to a read's merged results, its scores and its best pass."""
    rows = [(0, "eu", 0, 0, "captan", "133-06-2", "ok", "1"), (1, "epa", 1, 1, "folpet", "133-07-3", "ok", "1"), (2, "eu", 0, 2, "captanol", "", "ok", "1")]
    reg = spark.createDataFrame(rows, REGISTER)
    passes = spark.createDataFrame(
        [(1, 0, ["133-07-3"], ["capten"]), (1, 1, ["133-06-2", "133-07-3"], ["captan", "capten"]), (2, 0, [], ["nothing"]), (3, 0, None, None)],
        "read_id long, pass long, cas array<string>, names array<string>",
    )
    reads = mining.fused(passes)
    assert {x.read_id: (x.cas, x.names) for x in reads.collect()} == {1: (["133-07-3", "133-06-2"], ["capten", "captan"]), 2: ([], ["nothing"]), 3: ([], [])}
    scores = {x.read_id: (x.best, x.exact_name, x.exact_cas, x.name) for x in search.read_scores(reads, reg).collect()}
    assert scores == {1: (100, True, True, "captan"), 2: (0, False, False, None), 3: (0, False, False, None)}
    top = search.search_candidates(reads, reg, "farmer").collect()
    assert [(x.read_id, x.row_id, x.v) for x in sorted(top, key=lambda x: x.pos)] == [(1, 0, 100)]
    rated = spark.createDataFrame([(1, 0, 90, False, False, 50.0), (1, 1, 80, False, True, 10.0), (1, 2, 100, True, False, 99.0), (2, 0, 10, False, False, 9.0), (2, 1, 10, False, False, 9.0)],
                                  "read_id long, pass long, best long, exact_cas boolean, exact_name boolean, conf double")
    assert {x.read_id: x["pass"] for x in mining.best_pass(rated).collect()} == {1: 1, 2: 0}
    last = mining.latest(spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "k long, g long, v string"), "k", "g")
    assert sorted(x.v for x in last.collect()) == ["new", "only"]


def test_regions(spark):
    boxes = [(1, "ACTVE", 20.0, 50.0, 10.0, 90.0, 20.0), (1, "captan", 90.0, 40.0, 40.0, 99.0, 52.0), (1, "50%", 90.0, 45.0, 70.0, 60.0, 80.0), (1, "below", 90.0, 0.0, 150.0, 9.0, 160.0),
             (2, "no", 90.0, 0.0, 0.0, 9.0, 9.0), (3, "ACTIVE", 90.0, 0.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(boxes, "read_id long, text string, conf double, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(x) for x in mining.ingredient_regions(df, 100, 300).collect()] == [(1, 32.0, 4.0, 100.0, 86.0)]
    words = ["ACTIVE", "ACT", "ACTVE", "ingredints", "INGRXDIXNT", "NGREDI", "acorn", "", None, "AOTIVE", "ATCIVE"]
    assert picked(spark, lambda c: mining.header_word(F.col(c)), words) == [True, True, True, True, True, True, False, False, False, True, True]


def test_gates(spark):
    none, some = F.array().cast("array<string>"), F.array(F.lit("1071-83-6"))
    result = lambda text, cas, conf: one(spark, mining.gate_result(F.lit(text), cas, F.lit(conf)))
    assert [result("ابجد", some, 9), result("ابجد", none, 90), result("abc", none, 9), result("abc", none, 90)] == ["exempt_cas", "rejected_latin", "rejected_conf", "passed"]
    weak = lambda text, conf: one(spark, mining.weak_read(F.lit(text).cast("string"), F.lit(conf).cast("double")))
    assert [weak("a b c d", 90), weak("abcdef", None), weak("abcdef", 39.0), weak(None, 90)] == [True, False, True, True]
    names = F.array(F.lit(" Active Ingredients "), F.lit("captan"), F.lit("ingredient"))
    gated = lambda conf, cas, region, exact: one(spark, mining.gated_names(names, F.lit(conf).cast("int"), cas, F.lit(region), F.lit(exact)))
    assert [gated(39, none, False, True), gated(None, none, False, True), gated(40, none, False, True), gated(9, none, True, True), gated(9, some, False, True), gated(9, none, False, False)] == [[], []] + 4 * [["captan"]]


def test_display(spark):
    from registra.functions import display as S

    cell = lambda x: [tuple(y) for y in one(spark, S.described(F.lit(x).cast("string")))]
    assert cell("I/p.g.r و Xy") == [("I", "Insecticide", False), ("p.g.r", "Plant Growth Regulator", False), ("Xy", None, True)] and cell(None) == []
    lines = lambda x: one(spark, S.status_lines(F.lit(x).cast("string"), {"REV": "under review", "REV*": "see note"}, "the note"))
    assert [lines("REV*"), lines(" REV "), lines("other"), lines(None)] == [["see note", "under review", "the note"], ["under review"], [], []]
    text = lambda key, phrase, raw, details: one(spark, S.status_text(F.lit(key), F.lit(phrase), F.lit(raw).cast("string"), details))
    assert [text("500.rev", "decree: REV", "REV", True), text("500.unknown", "unknown", "ZZ", False), text("eu.pending", "pending", "Pending", True), text("eu.pending", "pending", "Pending", False), text("x", "p", None, True)] == [
        "decree: REV", "unknown (ZZ)", "pending · Pending", "pending", "p"]
    texts = {"ar": {"a": "A-ar"}, "en": {"a": "A-en", "b": "B-en"}}
    say = lambda k, lang: one(spark, S.message(F.lit(k), F.lit(lang), texts, F.lit("fallback")))
    assert [say("a", "en"), say("a", "fr"), say("b", "en"), say("b", "ar")] == ["A-en", "A-ar", "B-en", "fallback"]
    assert [one(spark, S.slug(F.lit(x).cast("string"))) for x in ("Zinc, oxide!", "", None, "--", "é" * 60)] == ["Zinc-oxide", "report", "report", "report", "é" * 40]
    assert [one(spark, S.cas_of_csv(F.lit(x))) for x in (" 50-00-0 ", "12345-6", "x")] == ["50-00-0", "12345-6", ""] and one(spark, S.cas_digits(F.lit("50-00-0"))) == "50000"
    assert one(spark, S.data_version(F.lit(""), F.lit("2026"))) == "2026" and one(spark, S.source_label(F.lit("zz"))) == "zz"
    rows = spark.createDataFrame([(" 1-2 ", "1071-83-6", "raw", "epa-master", None, " a ,b", None)], "cas string, cas_corrected string, cas_raw string, cas_source string, cas_stereo string, s string, cas_flag string")
    rows = rows.withColumn("cas_suggested", F.split("s", ",")).withColumns(dict.fromkeys(("cas_review", "cas_note", "duplicate_note"), F.lit(None).cast("string")))
    assert tuple(rows.select(S.corrections().alias("c")).first().c) == ("raw", "1071-83-6", "epa-master", "", "", ["a", "b"], "", "", "")
    shown = one(spark, S.shown_identifiers(F.lit("1071-83-6 and 1071-85-6, 12-34-5")))
    assert [tuple(x) for x in shown] == [("1071-83-6", False), ("1071-85-6", True), ("12-34-5", True)]
    codes = spark.createDataFrame([("s", "F", "fungi", False), ("s", "rep", "repels", True), ("t", "Q", "q", False)], "section string, code string, meaning string, transferred boolean")
    cells = spark.createDataFrame([(1, "s", "F.rep"), (2, "s", "F/Mi"), (3, "s", None), (4, "u", "F"), (5, "d", "as, is")], "id long, section string, cell string")
    got = {x.id: (x.title, x.attribution) for x in S.code_titles(cells, codes, ("d",), {"s": "notice"}).collect()}
    assert got == {1: ("fungi + repels", "notice"), 2: (f"fungi + Mi: {S.UNKNOWN}", ""), 3: ("", ""), 4: (f"F: {S.UNKNOWN}", ""), 5: ("as, is", "")}


def test_checks(spark):
    codes = spark.createDataFrame([("a", "F.1"), ("b", "G")], "section string, code string")
    rows = spark.createDataFrame([("a", "f1"), ("a", "G"), ("a", "G"), ("b", "F.1"), ("a", None)], "section string, code string")
    assert sorted(tuple(x) for x in R.uncovered(rows, codes).collect()) == [("a", "G", 2), ("b", "F.1", 1)]
    assert [tuple(x) for x in R.uncovered(rows, codes, {"a": "b"}).collect()] == [("b", "F.1", 1)]
    bad = R.outside_vocabulary(rows, "section", "code", {"a": ["f1"]})
    assert sorted((str(x.code), x.n) for x in bad.collect()) == [("G", 2), ("None", 1)]
    counted = R.ingest_counters(spark.createDataFrame([("a", "50-00-0"), ("a", ""), ("b", "x"), ("c", None)], "k string, cas string"), "k", "cas").first()
    assert tuple(counted) == (4, 3, 1, 2, 1)
    states = spark.createDataFrame([("eu", "ready", 5), ("epa", "failed", 9), ("canada", "ready", 0)], "source_key string, state string, rows long")
    assert tuple(search.totals(states).first()) == (3, 2, 5)
    reg = spark.createDataFrame([("eu", 1, "x", "c"), ("epa", 2, "y", "d"), ("canada", 3, "z", "e")], "source_key string, row long, name string, cas string")
    assert [x.row for x in search.available(reg, states).collect()] == [1]
    pairs = spark.createDataFrame([("eu", 1, "epa", 2), ("eu", 1, "epa", 9)], "a_source string, a_row long, b_source string, b_row long")
    assert sorted((x.a_name, str(x.b_name), x.found) for x in R.pair_rows(pairs, reg).collect()) == [("x", "None", False), ("x", "y", True)]
    gold = spark.createDataFrame([(1, "x"), (2, "other"), (7, "gone")], "row long, name string")
    assert sorted((x.row, x["class"]) for x in R.expected_against(reg, gold, "row", "name").collect()) == [(2, "differs"), (7, "missing")]
