"""Reading and writing registers: JSON, CSV, ZIP members, workbooks, packs, guarded refreshes, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

_TEXT = (
    "name name_norm name_fr cas cas_norm cas_raw cas_quality cas_source cas_note cas_stereo cas_flag cas_review category"
    " status status_raw source decision duplicate_note pc_code shared_cas_note cancel_reason expiry_date candidate_reason"
).split()
_INT = "row active_registrations cancelled_registrations shared_cas_count cancel_reason_count products registered_products".split()
_BOOL = "cas_multi shared_cas candidate_for_substitution basic_substance low_risk".split()
#: One schema for all registers; what a source doesn't have is null.
ROW = S.StructType(
    [S.StructField(x, S.StringType()) for x in _TEXT]
    + [S.StructField(x, S.LongType()) for x in _INT]
    + [S.StructField(x, S.BooleanType()) for x in _BOOL]
    + [S.StructField("cas_suggested", S.ArrayType(S.StringType()))]
)
META = S.StructType([S.StructField("key", S.StringType()), S.StructField("name", S.StringType()), S.StructField("count", S.LongType()), S.StructField("built", S.StringType()), S.StructField("cas_present", S.LongType())])
FILE = S.StructType([S.StructField("meta", META), S.StructField("rows", S.ArrayType(ROW))])


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """meta_key, ordinal and the superset's columns. A file without meta.key or rows raises."""
    files = spark.read.schema(FILE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    sound = F.when(F.col("meta.key").isNull() | F.col("rows").isNull(), F.raise_error(F.lit("no register: meta.key and rows are required"))).otherwise(F.col("rows"))
    rows = files.select(F.col("meta.key").alias("meta_key"), F.posexplode(sound).alias("ordinal", "r"))
    return rows.select("meta_key", "ordinal", "r.*")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of raw bytes, before any parsing."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, sha256: str | None) -> bool:
    """Whether the file has its pinned hash; None skips."""
    return sha256 is None or fingerprints(spark, path).filter(F.col("sha256") == sha256).count() == 1


def load(spark: SparkSession, candidates: list[str], expected: int | None = None, sha256: str | None = None) -> tuple[DataFrame, str]:
    """The first of candidates (each tried twice) that reads, and how it went: loaded, fallback, truncated (under
    95 % of expected) or unavailable with an empty table. Sources are independent of one another."""
    for number, path in enumerate(candidates):
        for _ in range(2):
            try:
                if not verified(spark, path, sha256):
                    break
                rows = read_register(spark, path)
                n = rows.count()
            except Exception as e:  # any unreadable candidate goes on to the next
                if isinstance(e, AnalysisException):
                    break
                continue
            if expected and n < 0.95 * expected:
                return rows, "truncated"
            return rows, "loaded" if number == 0 else "fallback"
    empty = S.StructType([S.StructField("meta_key", S.StringType()), S.StructField("ordinal", S.IntegerType()), *ROW.fields])
    return spark.createDataFrame([], empty), "unavailable"


def union(registers: list[DataFrame]) -> DataFrame:
    out = registers[0]
    for x in registers[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", header: bool = True, sep: str = ",", comment: str | None = None) -> DataFrame:
    """A CSV by RFC 4180. Charsets beyond Spark's own need spark.sql.legacy.javaCharsets, which is then set for the whole
    session and stays, as it is read when the file is."""
    if encoding.lower() not in {"utf-8", "utf-16", "utf-32", "us-ascii", "iso-8859-1"}:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.option("header", header).option("multiLine", True).option("quote", '"').option("escape", '"')
    reader = reader.option("encoding", encoding).option("sep", sep)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def read_zip_csv(spark: SparkSession, path: str, member: str, columns: int) -> DataFrame:
    """A CSV member of ZIP archives as c0, c1, ...: each archive is one file and read by one task."""
    schema = ", ".join(f"c{k} string" for k in range(columns))

    def rows(parts: Iterator) -> Iterator:
        import csv
        import io
        import zipfile

        import pandas as pd

        for pdf in parts:
            for content in pdf.content:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    reader = csv.reader(io.TextIOWrapper(f, "utf-8", newline=""))
                    held = []
                    for line in reader:
                        held.append((line + [None] * columns)[:columns])
                        if len(held) == 10_000:
                            yield pd.DataFrame(held, columns=[f"c{k}" for k in range(columns)])
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=[f"c{k}" for k in range(columns)])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def read_workbook(spark: SparkSession, path: str, sheet: int, columns: int) -> DataFrame:
    """A sheet of an .xlsx file by position, as strings c0, c1, ... (the first row is the header and left out)."""
    schema = ", ".join(f"c{k} string" for k in range(columns))

    def rows(parts: Iterator) -> Iterator:
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        for pdf in parts:
            for content in pdf.content:
                z = zipfile.ZipFile(io.BytesIO(content))
                shared = []
                if "xl/sharedStrings.xml" in z.namelist():
                    for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si"):
                        shared.append("".join(t.text or "" for t in si.iter(f"{ns}t")))
                out = []
                for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{ns}row"):
                    line: list = [None] * columns
                    for c in r.iter(f"{ns}c"):
                        k = 0
                        for x in re.match("[A-Z]+", c.get("r"))[0]:
                            k = 26 * k + ord(x) - 64
                        v, inline = c.find(f"{ns}v"), c.find(f"{ns}is")
                        text = "".join(t.text or "" for t in inline.iter(f"{ns}t")) if inline is not None else v.text if v is not None else None
                        if k <= columns and text is not None:
                            line[k - 1] = shared[int(text)] if c.get("t") == "s" else text
                    out.append(line)
                yield pd.DataFrame(out[1:], columns=[f"c{k}" for k in range(columns)])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """name and cas from a JSON array, {rows: [...]}, or a CSV with ; or , whose header names the columns."""
    head = "".join(x.value for x in spark.read.text(path).limit(5).collect()).lstrip("﻿ \t")
    if head[:1] in "[{":
        raw = spark.read.option("multiLine", True).json(path)
        df = raw.select(F.explode("rows").alias("r")).select("r.*") if "rows" in raw.columns else raw
    else:
        first = spark.read.text(path).first().value
        df = read_csv(spark, path, sep=";" if first.count(";") > first.count(",") else ",")
    return normal_rows(df)


#: Names under which sources have a column.
SYNONYMS = {
    "name": ("name", "substance", "active_substance", "Substance", "Active substance", "NAME"),
    "cas": ("cas", "cas_number", "CAS", "CAS Number", "CAS number"),
}


def normal_rows(df: DataFrame) -> DataFrame:
    def pick(names: tuple[str, ...]):
        own = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in names if c in df.columns]
        return F.coalesce(*own) if own else F.lit(None).cast("string")

    out = df.select(*[pick(names).alias(c) for c, names in SYNONYMS.items()])
    return out.filter("name IS NOT NULL")


def write_pack(rows: DataFrame, path: str, licence: str) -> DataFrame:
    """Parquet body and manifest (count, licence, row_hash: the sum of row hashes, whatever their order)."""
    rows.write.mode("overwrite").parquet(f"{path}/body")
    body = rows.sparkSession.read.parquet(f"{path}/body")
    manifest = body.agg(F.count(F.lit(1)).alias("count"), F.sum(F.xxhash64(*body.columns).cast("decimal(38,0)")).alias("row_hash"))
    manifest = manifest.withColumn("licence", F.lit(licence))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest


def install_pack(spark: SparkSession, path: str) -> DataFrame:
    """A pack's body, if it has rows and agrees with its manifest."""
    body, manifest = spark.read.parquet(f"{path}/body"), spark.read.parquet(f"{path}/manifest").first()
    now = body.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*body.columns).cast("decimal(38,0)")).alias("h")).first()
    if now.n == 0 or now.n != manifest["count"] or now.h != manifest["row_hash"]:
        raise ValueError(f"{path}: the pack doesn't agree with its manifest")
    return body


def packs(spark: SparkSession, root: str) -> list[str]:
    """The names of the packs under root that have a body and a manifest."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [x.getPath() for x in fs.listStatus(folder) if x.isDirectory()]
    part = lambda p, name: jvm.org.apache.hadoop.fs.Path(p, name)
    return sorted(p.getName() for p in found if fs.exists(part(p, "body")) and fs.exists(part(p, "manifest")))


def restore_packs(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The packs under root that still agree with their manifests, by name; others are left out."""
    out = {}
    for name in packs(spark, root):
        try:
            out[name] = install_pack(spark, f"{root}/{name}")
        except ValueError:
            continue
    return out


def remove_pack(spark: SparkSession, root: str, name: str) -> bool:
    """Whether there was a pack of that name; it is gone now."""
    if name not in packs(spark, root):
        return False
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def guarded_refresh(rows: DataFrame, path: str, version: str, least: int, apply: bool = False, protected: tuple[str, ...] = ()) -> str:
    """Write rows as path's current version; a dry run unless apply. Too few rows or a protected path are refused. The
    versions before stay as they are, each under its own name, as dated backups."""
    if any(p in path for p in protected):
        return "protected"
    if rows.limit(least).count() < least:
        return "too few rows"
    if not apply:
        return "dry run"
    rows.write.mode("errorifexists").parquet(f"{path}/version={version}")
    return "written"


def report_lines(rows: DataFrame, title: str, columns: list[str]) -> DataFrame:
    """A Markdown report as lines of text, for DataFrameWriter.text: a title, a table head, a line a row."""
    from ..functions.text import escape_html

    cell = lambda c: escape_html(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("/")))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    spark = rows.sparkSession
    head = [(f"# {title}",), ("",), ("| " + " | ".join(columns) + " |",), ("|" + "-|" * len(columns),)]
    return spark.createDataFrame(head, "value string").coalesce(1).union(rows.select(line.alias("value")))


def alert_lists(spark: SparkSession, path: str) -> DataFrame:
    """list_id, label, name, cas, note of every listed substance (one row with nulls for an empty list)."""
    sub = "array<struct<name:string,cas:string,note:string>>"
    schema = f"lists array<struct<id:string,label:string,nature:string,url:string,annex_url:string,fetched:string,substances:{sub}>>"
    lists = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("lists").alias("l"))
    each = lists.select("l.id", "l.label", "l.nature", F.explode_outer("l.substances").alias("s"))
    return each.select(F.col("id").alias("list_id"), "label", F.col("s.name").alias("name"), F.col("s.cas").alias("cas"), F.coalesce("s.note", "nature").alias("note"))


_ENTRY = "struct<i18nKey:string,transferredFrom:string,shapes:array<string>>"


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """section, kind (category, status, explanation), code, key (of the text), transferred (from another source's guide),
    shapes (other spellings), descriptive (the section's cells are no codes) of a reference dictionary's sections. An
    entry is an object, or the key alone."""
    text = spark.read.text(path, wholetext=True)
    lists = {"category": "categories", "status": "statusCodes", "explanation": "statusExplanations"}
    kinds = ",".join(f"{v}:map<string,string>" for v in lists.values())
    parsed = text.select(F.explode(F.from_json("value", f"struct<sections:map<string,struct<categoryKind:string,{kinds}>>>")["sections"]).alias("section", "x"))
    none = F.create_map().cast("map<string,string>")
    entry_of = lambda k: lambda e: F.struct(F.lit(k).alias("kind"), e["key"].alias("code"), e["value"].alias("raw"))
    each = [F.transform(F.map_entries(F.coalesce(f"x.{v}", none)), entry_of(k)) for k, v in lists.items()]
    rows = parsed.select("section", (F.coalesce("x.categoryKind", F.lit("")) == "descriptive").alias("descriptive"), F.explode(F.concat(*each)).alias("e"))
    entry = F.from_json("e.raw", _ENTRY)
    plain = ~F.startswith(F.ltrim("e.raw"), F.lit("{"))
    return rows.select(
        "section", "e.kind", "e.code", F.when(plain, F.col("e.raw")).otherwise(entry["i18nKey"]).alias("key"),
        F.coalesce(~plain & entry["transferredFrom"].isNotNull(), F.lit(False)).alias("transferred"),
        F.when(~plain, entry["shapes"]).alias("shapes"), "descriptive",
    )


def to_json_register(rows: DataFrame, key: str, limit: int = 1_000_000) -> str:
    """A register file's text, for registers small enough to be one JSON document: at most limit rows are fetched, and one
    more to tell."""
    found = [json.loads(x) for x in rows.limit(limit + 1).toJSON().collect()]
    if len(found) > limit:
        raise ValueError("too many rows for one JSON document; write a pack")
    return json.dumps({"meta": {"key": key, "count": len(found)}, "rows": found}, ensure_ascii=False)


def review_export(rows: DataFrame, path: str, verdict: str = "verdict", note: str = "note") -> None:
    """Reviewed rows as JSON lines in order of row: row, name, cas and the reviewer's verdict and note; rows without a
    verdict are written too, so that the review can go on."""
    rows.select("row", "name", "cas", F.col(verdict).alias("verdict"), F.col(note).alias("note")).orderBy("row").write.mode("overwrite").json(path)
