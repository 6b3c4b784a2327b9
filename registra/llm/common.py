"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..plans.shared import held, release, remove, scratch, shared_dir, written  # noqa: F401

#: ASCII white space of the word contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
_ASCII_SPACE = b" \t\n\x0b\x0c\r"

#: Byte tables for bytes.translate; both lower-case A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

_shipped: set[str] = set()
_lock = threading.Lock()


def prepare(spark: SparkSession, rows_per_batch: int = 512) -> SparkSession:
    """Make this package importable on executors and keep Arrow batches small, as texts can be long. The batch size is
    the session's, and stays, as results are computed after the operator has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))
    app = spark.sparkContext.applicationId
    with _lock:
        if app not in _shipped:
            root = Path(__file__).resolve().parents[1]
            archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
            with zipfile.ZipFile(archive, "w") as z:
                for p in sorted(root.rglob("*.py")):
                    z.write(p, p.relative_to(root.parent))
            spark.sparkContext.addPyFile(str(archive))
            _shipped.add(app)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(data: bytes) -> list[bytes]:
    """Maximal runs without ASCII white space (split() on bytes knows exactly those six characters)."""
    return data.split()


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tokenizer_path() -> str:
    """Where the public vocabulary file is; a parameter everywhere, this is its default."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def clear_local_env() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
