"""Scalar functions on names, identifiers and label text, as Column expressions.

Everything here is native; only nfkd() runs Python (Arrow batches), for text that the character table of
fold_accents() can't express: characters that decompose into several.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

CAS = r"^\d{2,7}-\d{2}-\d$"
CAS_ANYWHERE = r"\d{2,7}-\d{2}-\d"
CAS_SPACED = r"\d[\d ]*\d\s*-\s*\d[\d ]*\d\s*-\s*\d"
#: White space as text sources have it: ASCII, no-break and typographic spaces, the byte order mark.
SPACE = r"[\s   -     　﻿]"
HARAKAT = "".join(map(chr, [*range(0x64B, 0x660), 0x670]))

#: Arabic letters that count as another, for search keys and for verdict keys.
SEARCH_FOLDS = {"إ": "ا", "أ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه"}
VERDICT_FOLDS = {**SEARCH_FOLDS, "ؤ": "و", "ئ": "ي"}

#: What a cell says instead of an identifier.
NO_CAS = r"(?i)^(no cas allocated|no unique cas|see (remark|note|notes)|n/a|-|none)$"


@cache
def _accents() -> tuple[str, str]:
    """Characters of the basic plane that compatibility decomposition turns into one character and marks."""
    a, b = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F)
        if len(plain) == 1 and plain != c:
            a.append(c)
            b.append(plain)
    return "".join(a), "".join(b)


def fold_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *_accents()), r"[̀-ͯ]", "")


@pandas_udf(StringType())
def nfkd(s):
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x))


def _folded(c: Column, folds: dict[str, str]) -> Column:
    return F.translate(c, "".join(folds) + HARAKAT + "ـ", "".join(folds.values()))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def norm(c: Column, exact: bool = False) -> Column:
    """Search key: no accents, lower case, Arabic folds, letters, digits, blanks, dots, slashes, hyphens.
    exact: decompose with nfkd() first, for text with ligatures and the like."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    c = F.lower(fold_accents(nfkd(c) if exact else c))
    c = _folded(c, SEARCH_FOLDS)
    return squeeze(F.regexp_replace(c, r"[^\p{L}\p{N}\s./\-]", " "))


def compact(c: Column) -> Column:
    """A search key without blanks, dots, slashes and hyphens; c is a norm()."""
    return F.regexp_replace(c, r"[\s./\-]", "")


def is_cas(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(CAS), F.lit(False))


def cas_numbers(c: Column) -> Column:
    """All identifiers in a cell, in order."""
    c = F.coalesce(c, F.lit(""))
    return F.when(is_cas(c), F.array(F.trim(c))).otherwise(F.regexp_extract_all(c, F.lit(CAS_ANYWHERE), F.lit(0)))


def cas_checksum(c: Column, most: int = 10) -> Column:
    """Whether the last digit is the sum of the others, each times its place from the right, modulo 10;
    null if there are fewer than 5 or more than `most` digits."""
    d = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    places = F.sequence(F.lit(1), F.length(d) - 1)
    total = F.aggregate(
        places, F.lit(0), lambda a, i: a + F.substring(F.reverse(d), i + 1, F.lit(1)).cast("int") * i
    )
    fits = F.length(d).between(5, most)
    return F.when(fits, total % 10 == F.substring(d, -1, 1).cast("int"))


def parse_cas_cell(c: Column) -> Column:
    """array<struct<cas, checksum_ok>>, blanks inside a number allowed."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CAS_SPACED), F.lit(0))
    return F.transform(
        found,
        lambda x: F.struct(
            F.replace(x, F.lit(" "), F.lit("")).alias("cas"),
            cas_checksum(x, 11).alias("checksum_ok"),
        ),
    )


def cas_cell_is_empty(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    digits = F.replace(t, F.lit(" "), F.lit("")).rlike(r"\d{2,}")
    return (t == "") | t.rlike(NO_CAS) | ((F.size(parse_cas_cell(t)) == 0) & ~digits)


def verdict_key(c: Column) -> Column:
    """Key for verdicts: dashes and exotic spaces made plain, Arabic folds, lower case, tight around
    hyphens, slashes and brackets, commas as blanks."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    c = F.regexp_replace(F.regexp_replace(c, r"[‐-―]", "-"), r"[  -​]", " ")
    c = F.lower(_folded(F.regexp_replace(c, r"[ً-ْٰـ]", ""), VERDICT_FOLDS))
    for mark in ("-", "/", r"\[", r"\]"):
        c = F.regexp_replace(c, rf"{SPACE}*{mark}{SPACE}*", mark)
    return squeeze(F.replace(c, F.lit(","), F.lit(" ")))


def digit_runs(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), " ")


def stereo_marks(c: Column) -> Column:
    """The e and z letters of bracketed groups (12 characters at most) and isomer words, sorted."""
    groups = F.filter(F.regexp_extract_all(c, F.lit(r"\([^)]*\)"), F.lit(0)), lambda g: F.length(g) <= 12)
    letters = F.transform(groups, lambda g: F.lower(F.regexp_replace(g, "[^ezEZ]", "")))
    named = F.array(*[F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in ("alpha", "beta", "gamma", "trans", "cis")])
    return F.array_sort(F.filter(F.concat(letters, named), lambda x: x.isNotNull() & (x != "")))


def judge_name(q: Column, s: Column) -> Column:
    """exact, similar, probable or null for two verdict keys."""
    least = F.least(F.length(q), F.length(s))
    allowed = F.when(least < 5, 0).when(least <= 8, 1).otherwise(2)
    edits = F.levenshtein(q, s, 2)
    return (
        F.when((q == "") | (s == "") | q.isNull() | s.isNull(), F.lit(None).cast("string"))
        .when(q == s, F.lit("exact"))
        .when(F.contains(q, s) | F.contains(s, q), F.lit("similar"))
        .when((stereo_marks(q) != stereo_marks(s)) | (digit_runs(q) != digit_runs(s)), F.lit("similar"))
        .when((edits >= 0) & (edits <= allowed), F.lit("probable"))
    )


def head_name(c: Column) -> Column:
    """What stands before the first bracket, or the empty string."""
    return F.when(c.rlike(r"^[^(\[]+[(\[]"), verdict_key(F.regexp_extract(c, r"^[^(\[]+", 0))).otherwise(F.lit(""))


def cat_fold(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[.\s]", ""))


def code_parts(c: Column, known: Column) -> Column:
    """Parts of a code cell: cut at / , + and at dots where every dotted part is in known (an array)."""
    hard = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[/,+]"), lambda x: F.trim(x)), lambda x: x != "")

    def dotted(p: Column) -> Column:
        parts = F.transform(F.split(p, r"\."), lambda x: F.trim(x))
        cut = F.contains(p, F.lit(".")) & F.forall(parts, lambda x: F.array_contains(known, x))
        return F.when(cut, F.filter(parts, lambda x: x != "")).otherwise(F.array(p))

    return F.flatten(F.transform(hard, dotted))


LATIN = "".join(map(chr, [*range(65, 91), *range(97, 123)]))
#: The characters of SPACE, one by one.
BLANKS = "\t\n\x0b\x0c\r " + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def _without(c: Column, characters: str) -> Column:
    return F.length(F.translate(c, characters, ""))


def latin_ratio(c: Column) -> Column:
    """Latin letters by visible characters; 1 for none."""
    c = F.coalesce(c, F.lit(""))
    seen = _without(c, BLANKS)
    return F.when(seen == 0, F.lit(1.0)).otherwise((F.length(c) - _without(c, LATIN)) / seen)


def rejected_reason(text: Column, cas: Column, conf: Column, ratio: Column | None = None) -> Column:
    """mixed, conf or null; a valid identifier waives both. ratio: the text's latin_ratio, where it is there already."""
    valid = F.coalesce(F.exists(cas, lambda x: F.coalesce(cas_checksum(x), F.lit(False))), F.lit(False))
    ratio = latin_ratio(text) if ratio is None else ratio
    return F.when(~valid & (ratio < 0.6), F.lit("mixed")).when(~valid & F.coalesce(conf < 45, F.lit(False)), F.lit("conf"))


def pass_score(best: Column, exact_cas: Column, exact_name: Column, conf: Column) -> Column:
    tier = (
        F.when(exact_cas, 250).when(exact_name, 200).when(best >= 96, 150).when(best >= 90, 100).when(best >= 80, 50)
    ).otherwise(0)
    return best + tier + F.least(F.coalesce(conf, F.lit(0)), F.lit(100)) * 0.3


def pooled_confidence(conf: Column, votes: Column) -> Column:
    return F.coalesce(conf, F.lit(0)) * F.least(votes, F.lit(12))


#: Application identifiers and what they stand for.
GS1 = {"01": "gtin", "10": "batch", "21": "serial", "30": "count"}


def gs1_field(c: Column, name: str) -> Column:
    """A field of a (01)...(10)... string, the last of its kind; null if there is none."""
    code = next(k for k, v in GS1.items() if v == name)
    found = F.regexp_extract_all(c, F.lit(rf"\({code}\)([^(]*)"), F.lit(1))
    return F.when(c.startswith("(") & (F.size(found) > 0), F.trim(F.try_element_at(found, F.lit(-1))))


def safe_code(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9 .,\-+/()%]{3,80}$")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def mixed_script_words(c: Column) -> Column:
    """Words with both Arabic and Latin letters, marks aside."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    plain = lambda w: F.regexp_replace(w, r"[ً-ْ]", "")
    return F.filter(found, lambda w: plain(w).rlike(r"[؀-ۿ]") & plain(w).rlike(r"\p{IsLatin}"))


def foreign_characters(c: Column) -> Column:
    """How many ideographs, kana, full-width and replacement characters."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[�一-鿿぀-ヿ＀-￯]"))


def translated(template: Column, values: dict[str, Column]) -> Column:
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v.cast("string"))
    return template


def js_round(c: Column) -> Column:
    return F.floor(c + 0.5).cast("bigint")
