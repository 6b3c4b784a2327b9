"""Line-first cleaning with DataFrame functions only.

Every line is judged by itself, failing lines go, and a document goes when the base rule fails or when
it lost more than ``max_loss`` of its words.

Line rules (n: words of the line)
  symbols      2 * characters of ``[#*$%&|<>]`` >= n
  marks        ``!`` and ``?`` together > n (shouted or spliced text)
  navigation   at least two of ``|›•·`` and 3 times as many as words, or more (menus, bread crumbs, tables of links)
  boilerplate  at most 20 words that hold one of BOILERPLATE, whatever the text's language
  punctuation  fewer than 5 words that don't end in terminal punctuation (headings, buttons)
  blank lines carry no words and are dropped from the cleaned text.

Defined results: a null or empty text has no words, fails the base rule and is not kept; repeated rows
are judged one by one; columns of the input whose names clash with results are replaced by the results
(``judge`` adds the columns below and leaves all other columns alone); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Phrases of page furniture in English, German, French and Spanish, matched in lower case (A-Z).
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here",
    "sign up for our newsletter", "subscribe to our", "enable javascript", "skip to content", "share on facebook", "lorem ipsum",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerkl", "nutzungsbedingungen", "hier klicken", "newsletter anmelden",
    "javascript aktivieren", "zum inhalt springen", "auf facebook teilen",
    "tous droits r", "accepter les cookies", "politique de confidentialit", "conditions d'utilisation", "cliquez ici", "inscrivez-vous",
    "activer javascript", "aller au contenu", "partager sur facebook",
    "todos los derechos reservados", "aceptar cookies", "de privacidad", "condiciones de uso", "haga clic", "suscr",
    "activar javascript", "saltar al contenido", "compartir en facebook",
)
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|›•·"
BLANKS = " \t\n\x0b\x0c\r"
#: Marks that end a sentence, and what may close it behind them.
TERMINAL, CLOSING = ".!?:;…。！？", "\"'”’»)]"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOSS = 0.5
MAX_BOILERPLATE_WORDS = 20
MIN_UNPUNCTUATED_WORDS = 5


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _line_facts(line: Column) -> Column:
    last = F.right(F.rtrim(F.rtrim(line, F.lit(BLANKS)), F.lit(CLOSING)), F.lit(1))
    return F.struct(
        line.alias("line"),
        F.regexp_count(line, F.lit(WORD)).alias("n"),
        _count_of(line, SYMBOLS).alias("symbols"),
        _count_of(line, "!?").alias("marks"),
        _count_of(line, SEPARATORS).alias("bars"),
        ((last != "") & F.contains(F.lit(TERMINAL), last)).alias("ended"),
    )


def _line_passes(x: Column) -> Column:
    """The rules, cheap ones first; the phrases are looked for in short lines that pass the others alone."""
    n = x["n"]
    low = F.translate(x["line"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (
        (n > 0)
        & (2 * x["symbols"] < n)
        & (x["marks"] <= n)
        & ~((x["bars"] >= 2) & (3 * x["bars"] >= n))
        & ((n >= MIN_UNPUNCTUATED_WORDS) | x["ended"])
        & ((n > MAX_BOILERPLATE_WORDS) | ~low.rlike("|".join(BOILERPLATE)))
    )


def _covered(starts: Column) -> Column:
    """Words in 3-word windows at the given ascending starts: 3, or less where the next start is nearer."""
    steps = F.transform(
        starts, lambda p, i: F.coalesce(F.least(F.get(starts, i + 1) - p, F.lit(3)), F.lit(3)).cast("bigint")
    )
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, b: a + b)


def judge(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept
    (boolean), n_kept_words (long) and clean_text (the passing lines, joined by a newline).

    Repeated windows are found by sorting, for every text, one long per window: the high bits of the
    window's 64-bit hash over its position. Neighbours with equal high bits are compared word for word;
    a text in which unequal windows meet there is done again by sorting the windows themselves.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_kept_words", "clean_text",
    ]
    others = [c for c in docs.columns if c not in own]
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"),
        t.alias("_t"),
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_w"),
    )
    w, n = F.col("_w"), F.size("_w")
    none = F.array().cast("array<bigint>")
    bits = F.length(F.bin(n.cast("bigint")))
    df = df.withColumn("_bits", bits.cast("int"))
    step = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bits"))
    df = df.withColumn("_step", step)
    packed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(-F.col("_step"))
        + i.cast("bigint"),
    )
    df = df.withColumn("_p", F.when(n >= 3, F.sort_array(packed)).otherwise(none))
    p, low = F.col("_p"), F.col("_step") - 1
    high = lambda x: x.bitwiseAND(-F.col("_step"))
    near = F.filter(
        p,
        lambda x, i: F.coalesce(high(F.get(p, i - 1)) == high(x), F.lit(False))
        | F.coalesce(high(F.get(p, i + 1)) == high(x), F.lit(False)),
    )
    df = df.withColumn("_near", near)
    near = F.col("_near")

    def clash(x: Column, i: Column) -> Column:
        before = F.get(near, i - 1)
        a, b = x.bitwiseAND(low).cast("int"), before.bitwiseAND(low).cast("int")
        same = (
            (F.get(w, a) == F.get(w, b))
            & (F.get(w, a + 1) == F.get(w, b + 1))
            & (F.get(w, a + 2) == F.get(w, b + 2))
        )
        return F.coalesce((high(x) == high(before)) & ~same, F.lit(False))

    fast = F.transform(near, lambda x: x.bitwiseAND(low))
    hit = F.exists(F.transform(near, clash), lambda x: x)
    df = df.withColumn("_hit", hit)
    exact = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(
                F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"),
                i.cast("bigint").alias("i"),
            ),
        )
    )
    df = df.withColumn("_slow", F.when(F.col("_hit") & (n >= 3), exact))
    s = F.col("_slow")
    three = lambda x: F.struct(x["a"], x["b"], x["c"])
    slow = F.transform(
        F.filter(
            s,
            lambda x, i: F.coalesce(three(F.get(s, i - 1)) == three(x), F.lit(False))
            | F.coalesce(three(F.get(s, i + 1)) == three(x), F.lit(False)),
        ),
        lambda x: x["i"],
    )
    df = df.withColumn("_starts", F.sort_array(F.when(F.col("_hit"), slow).otherwise(fast)))
    lines = F.transform(F.split(F.col("_t"), "\n", -1), _line_facts)
    df = df.withColumn("_lines", F.filter(lines, lambda x: x["n"] > 0))
    all_lines = F.transform(F.col("_lines"), lambda x: x["line"])
    df = df.withColumn("_passing", F.filter("_lines", _line_passes))
    facts = F.struct(
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("bigint").alias("word_chars"),
        _count_of(F.col("_t"), SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct(all_lines))).cast("bigint").alias("n_dup_lines"),
        _covered(F.col("_starts")).alias("n_repeat_words"),
        F.aggregate("_passing", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("n_kept_words"),
        F.array_join(F.transform("_passing", lambda x: x["line"]), "\n").alias("clean_text"),
    )
    # A generator stands between the facts and what is made of them: predicates on its columns stay above it. Pushed
    # down, nested lambdas would compute the arrays that they look at anew for every element.
    df = df.select("_row", F.inline(F.array(facts)))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    lost = F.col("n_words") - F.col("n_kept_words")
    kept = ~failed & (lost <= max_loss * F.col("n_words"))
    df = df.withColumn("base_failed", failed).withColumn("kept", kept)
    return df.select(*[F.col("_row").getField(c).alias(c) for c in others], *own)


def clean(docs: DataFrame) -> DataFrame:
    """Kept rows of docs, the cleaned text as text, n_chars (if there) following it."""
    kept = judge(docs).filter("kept").withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("bigint"))
    return kept.select(*docs.columns)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_kept_words",
    )


_PHRASES = "|".join(BOILERPLATE).replace("'", "''")
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS l FROM d
), tri AS (
  SELECT k, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3
), rep AS (
  SELECT k, p, count(*) OVER (PARTITION BY k, w[p], w[p + 1], w[p + 2]) AS n FROM tri
), cov AS (
  SELECT k, count(DISTINCT p + o) AS n
  FROM rep, (VALUES (0), (1), (2)) AS v(o) WHERE n > 1 GROUP BY k
), line AS (
  SELECT k, unnest(l) AS x, unnest(range(len(l))) AS i FROM w
), facts AS (
  SELECT k, i, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
    length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS symbols,
    length(x) - length(regexp_replace(x, '[!?]', '', 'g')) AS marks,
    length(x) - length(regexp_replace(x, '[|›•·]', '', 'g')) AS bars,
    regexp_matches(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PHRASES}') AS furniture,
    regexp_matches(x, '[.!?:;…。！？][\x22\x27”’»)\]]*[\x20\x09-\x0D]*$') AS ended
  FROM line
), byline AS (
  SELECT k, count(*) - count(DISTINCT x) AS dups,
    coalesce(sum(n) FILTER (WHERE 2 * symbols < n AND marks <= n AND NOT (bars >= 2 AND 3 * bars >= n)
      AND NOT (furniture AND n <= {MAX_BOILERPLATE_WORDS}) AND (n >= {MIN_UNPUNCTUATED_WORDS} OR ended)), 0) AS kept_words
  FROM facts WHERE n > 0 GROUP BY k
), r AS (
  SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(b.dups, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(b.kept_words, 0) AS BIGINT) AS n_kept_words
  FROM d JOIN w USING (k) LEFT JOIN cov c USING (k) LEFT JOIN byline b USING (k)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND n_words - n_kept_words <= {MAX_LOSS} * n_words AS kept
FROM r
"""
