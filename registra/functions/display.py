"""What a result shows of a row: statuses, codes, sources, corrections. Values as the source has them, never a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: The codes that the official guides explain.
CODES = {
    "I": "Insecticide", "F": "Fungicide", "A": "Acaricide", "N": "Nematicide", "H": "Herbicide", "R": "Rodenticide",
    "M": "Molluscicide", "S.Ph": "Sex Pheromone", "PGR": "Plant Growth Regulator", "P.G.R": "Plant Growth Regulator",
    "Rep": "Repellent", "rep": "Repellent", "V": "Viruses / Microbials",
}
SEPARATORS = r"[+/,؛;]| و "
#: The sources' names, and the notices that their licences ask for.
LABELS = {
    "libya-248": "ليبيا، قرار 248 لسنة 2024", "libya-500": "ليبيا، قرار 500 لسنة 2026", "eu": "الاتحاد الأوروبي", "epa": "USA / EPA",
    "epa-cancelled": "USA / EPA — أرشيف الملغى", "canada": "كندا — سجل المبيدات الوطني (PMRA)", "australia": "أستراليا — APVMA",
}
NOTICES = {
    "canada": "Contains information licensed under the Open Government Licence – Canada.",
    "australia": "Contains information licensed under the Creative Commons Attribution 3.0 Australia licence.",
}


def lookup(values: dict[str, str], key: Column) -> Column:
    """values[key], or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.coalesce(key, F.lit("")))


def trimmed(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def message(key: Column, language: Column, texts: dict[str, dict[str, str]], fallback: Column | None = None) -> Column:
    """The text of a key in a language; languages without a dictionary use Arabic; without a text the fallback, else the key."""
    known = F.when(language.isin(*texts), language).otherwise(F.lit("ar"))
    found = F.coalesce(*[F.when(known == name, lookup(d, key)) for name, d in texts.items()])
    return F.coalesce(found, fallback, key) if fallback is not None else F.coalesce(found, key)


def described(cell: Column, codes: dict[str, str] = CODES) -> Column:
    """array<struct<code, meaning, unknown>> of a code cell, in its order; a null or empty cell has none. Dots, blanks and
    case don't distinguish codes; where codes fold alike the first in codes counts."""
    folded: dict[str, str] = {}
    for k, v in codes.items():
        folded.setdefault(k.lower().replace(".", "").replace(" ", ""), v)
    parts = F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), SEPARATORS), lambda x: F.trim(x)), lambda x: x != "")
    meaning = lambda x: lookup(folded, T.cat_fold(x))
    return F.transform(parts, lambda x: F.struct(x.alias("code"), meaning(x).alias("meaning"), meaning(x).isNull().alias("unknown")))


def status_lines(status: Column, explanations: dict[str, str], note: str) -> Column:
    """The lines that explain a status: its own; with REV* also REV's and the asterisk's; none for an unknown one."""
    s = trimmed(status)
    own = F.coalesce(lookup(explanations, s), F.lit(""))
    rest = F.when(s == "REV*", F.array(F.lit(explanations.get("REV", "")), F.lit(note))).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.concat(F.array(own), rest), lambda x: x != "")
    return F.when(own == "", F.array().cast("array<string>")).otherwise(lines)


def status_text(key: Column, phrase: Column, raw: Column, details: bool, restricted: Column | None = None) -> Column:
    """A status' phrase, with the raw term behind it where the phrase doesn't name it: in brackets for the decree's
    own statuses, behind a dot for others if details are wanted; and the note on restricted use."""
    raw = F.coalesce(raw, F.lit(""))
    named = (raw != "") & F.contains(phrase, raw)
    own = key.startswith("500.") | key.startswith("st.500.")
    more = F.when(own & (raw != "") & ~named, F.concat(F.lit(" ("), raw, F.lit(")")))
    if details:
        more = more.when(~own & (raw != "") & ~named, F.concat(F.lit(" · "), raw))
    out = F.concat(phrase, F.coalesce(more, F.lit("")))
    if restricted is not None:
        out = F.concat(out, F.when(restricted, F.lit(" · restricted use")).otherwise(F.lit("")))
    return out


def source_label(key: Column) -> Column:
    return F.coalesce(lookup(LABELS, key), key)


def source_notice(key: Column) -> Column:
    return F.coalesce(lookup(NOTICES, key), F.lit(""))


def data_version(built: Column, checked: Column) -> Column:
    """When a source's data are from: its build, else its check date, else the empty string."""
    return F.coalesce(F.nullif(built, F.lit("")), checked, F.lit(""))


def slug(c: Column) -> Column:
    """For file names: letters and digits, runs of others as one hyphen, at most 40 characters."""
    s = F.regexp_replace(T.squeeze(F.coalesce(F.nullif(c, F.lit("")), F.lit("report"))), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 40), F.lit("")), F.lit("report"))


def corrections() -> Column:
    """struct<raw, corrected, source, stereo, flag, suggested, review, note, duplicate> of a register row. A row is
    corrected if it has a corrected value; only then the raw cell differs from the printed one."""
    at = lambda c: trimmed(F.col(c))
    is_corrected = at("cas_corrected") != ""
    suggested = F.filter(F.transform(F.coalesce("cas_suggested", F.array().cast("array<string>")), lambda x: trimmed(x)), lambda x: x != "")
    return F.struct(
        F.when(is_corrected, at("cas_raw")).otherwise(at("cas")).alias("raw"), F.when(is_corrected, at("cas_corrected")).otherwise(F.lit("")).alias("corrected"),
        F.when(is_corrected, at("cas_source")).otherwise(F.lit("")).alias("source"), at("cas_stereo").alias("stereo"), at("cas_flag").alias("flag"),
        suggested.alias("suggested"), at("cas_review").alias("review"), at("cas_note").alias("note"), at("duplicate_note").alias("duplicate"),
    )


def shown_identifiers(cell: Column) -> Column:
    """array<struct<cas, wrong>>: a cell's identifiers, those with a wrong check digit marked (too few digits to tell
    aren't wrong)."""
    return F.transform(T.cas_numbers(cell), lambda c: F.struct(c.alias("cas"), F.coalesce(~T.cas_checksum(c), F.lit(False)).alias("wrong")))


def cas_of_csv(c: Column) -> Column:
    """A well-formed identifier, or five to nine digits, a hyphen and a digit; else the empty string."""
    v = T.squeeze(F.coalesce(c, F.lit("")))
    return F.when(v.rlike(T.CAS) | v.rlike(r"^\d{5,9}-\d$"), v).otherwise(F.lit(""))


def cas_digits(c: Column) -> Column:
    """The digits of a well-formed identifier, else the empty string."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike(T.CAS), F.replace(c, F.lit("-"), F.lit(""))).otherwise(F.lit(""))


UNKNOWN = "code not explained in this source's guide"


def code_titles(rows: DataFrame, codes: DataFrame, descriptive: tuple[str, ...] = (), notices: dict[str, str] | None = None) -> DataFrame:
    """rows (id, section, cell) with title and attribution.

    codes: section, code, meaning, transferred (taken from another source's guide). The parts' meanings are joined by
    `` + ``; a part without one is named. A descriptive section's cells are printed as they are. A section's notice
    (notices) is shown only where a part's meaning is transferred. Codes are a dictionary: of each section the list of
    codes goes along with its rows, to cut cells at dots."""
    known = codes.groupBy("section").agg(F.collect_set("code").alias("_known"))
    facts = codes.groupBy("section", T.cat_fold(F.col("code")).alias("_k")).agg(
        F.min_by(F.struct("meaning", "transferred"), F.struct("transferred", "code")).alias("_e")
    )
    none = F.array().cast("array<string>")
    cut = rows.join(known, "section", "left").select("id", "section", "cell", T.code_parts(F.trim("cell"), F.coalesce("_known", none)).alias("_parts"))
    parts = cut.select("id", "section", "cell", F.posexplode_outer("_parts").alias("_i", "_part"))
    parts = parts.withColumn("_k", T.cat_fold(F.col("_part"))).join(facts, ["section", "_k"], "left")
    text = F.coalesce(F.col("_e.meaning"), F.concat(F.col("_part"), F.lit(f": {UNKNOWN}")))
    out = parts.groupBy("id", "section", "cell").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_i"), text.alias("t")))), lambda x: x["t"]), " + ").alias("_title"),
        F.coalesce(F.bool_or("_e.transferred"), F.lit(False)).alias("_via"),
    )
    plain = F.col("section").isin(*descriptive) if descriptive else F.lit(False)
    notice = F.coalesce(lookup(notices, F.col("section")), F.lit("")) if notices else F.lit("")
    return out.select(
        "id", "section", "cell", F.when(plain, F.coalesce("cell", F.lit(""))).otherwise(F.col("_title")).alias("title"),
        F.when(F.col("_via"), notice).otherwise(F.lit("")).alias("attribution"),
    )
