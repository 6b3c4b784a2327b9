"""The corpus pipeline: quality rules, near-duplicates, contamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns documents'
columns; the last returns what the token files hold. run() writes every stage's result to the shared
folder and reads it again, so that a lost executor costs a stage's tasks and not the pipeline, and
removes what only the stages before needed.

Defined results: null and empty texts fail the quality rules and go, as do texts that lose too much; equal
rows are one document from the second stage on; null ids stay (documents without an id are told apart by
their text, and come first in the token files); a null source is a source of its own; the mix repeats a
document once for each round in which its words are taken; columns beyond documents' are left out; an
empty table, or one of which nothing is kept, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from registra.llm import fm_decontamination, quality_rules, simhash_pivots, source_mixing, token_output
from registra.llm.common import held, prepare, release, table, tokenizer_path, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept documents, with their failing lines removed."""
    return quality_rules.clean(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return simhash_pivots.keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents."""
    return fm_decontamination.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each round in which a document's words are taken."""
    return source_mixing.mix(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files."""
    return token_output.digest(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("SimHash near-duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix),
    ("token output", tokens),
]

#: SQL has no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, others = table(spark, sf_dir, "documents"), held()
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        release(spark, others, keep=(docs.scratch_path,))
    out = STAGES[-1][1](spark, docs, sf_dir)
    release(spark, [x for x in held() if x != docs.scratch_path])
    return out
