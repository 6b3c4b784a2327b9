"""Token ids in byte-aligned variable-length coding with separate control bytes.

File format (little-endian; one file per range of documents, files in ascending order). A file is a run of
segments, each with at most SEGMENT ids or one document:
  magic ``RGV2``; n_docs u64; n_ids u64; n_data u64; n_ranks u32
  rank table: n_ranks u32, the segment's ids by falling frequency, then by id
  document table: n_docs i64 ids, n_docs u8 null flags, n_docs u64 token counts
  control bytes: one for four values, two bits a value, low bits first: length - 1
  data bytes (n_data): each value's rank in 1 to 4 bytes

Each segment ranks its own ids, so that one pass over the text writes it, any part of a file can be read
alone, a task holds one segment whatever the size of its range, and a lost task rewrites only its own
file. A file is written under a name of its attempt and then renamed; attempts write equal bytes.

Tokenizing: the vocabulary's pre-tokenizer never crosses a single blank or newline between two visible
characters (a blank goes with the word behind it, a newline stands alone), so that such texts are cut
there and a worker encodes a frequent piece once. Texts with other white space
or control characters, or with a special token's string, go to the tokenizers library whole, and so do all
texts where the vocabulary isn't of that kind. Ids equal those of the whole text.

Defined results: null and empty texts have the end id only; rows with a null id come first; repeated ids
are ordered by the text's hash, then the text; extra columns are ignored; an empty table gives no file.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"RGV2"
SEGMENT = 1 << 20  # ids of a segment, about
_HEAD = struct.Struct("<4sQQQI")
_MEMO: dict[str, tuple] = {}
_MEMO_ENTRIES = 200_000
_MEMO_BARE = 10_000
_MEMO_CHARS = 64
#: Anything but single blanks and newlines between visible characters.
_IRREGULAR = re.compile(
    r"[\x00-\x09\x0b-\x1f\x7f-\xa0\xad؀-؅؜ ᠎ -‏ -  -⁯"
    r"　﻿]|[ \n][ \n]|\A[ \n]|[ \n]\Z"
)

#: Bytes of visible characters that need no closer look: ASCII, then letters of two and three bytes.
_PLAIN = bytes([10, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xD8), *range(0xE4, 0xEA)])


def irregular(text: str) -> bool:
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return True
    return bool(text.encode().translate(None, _PLAIN)) and _IRREGULAR.search(text) is not None


#: By control byte: the lengths of its four values.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + 1

#: A blank and letters or digits, then ASCII marks: one pre-token each, in any byte-level vocabulary.
_PARTS = re.compile(r"( ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+))?([!-/:-@\[-`{-~]*)")


def _byte_characters() -> str:
    """By byte: the character that stands for it in byte-level vocabularies (visible ones for themselves)."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in visible else next(others)) for b in range(256))


BYTE_CHARACTERS = _byte_characters()


class Memo(dict):
    """Words to ids' bytes, in two generations: a word is remembered for a while (young), and stays once it is met
    again, so that frequent words outlive the many that occur once. Keys are what stands behind a blank; those that
    begin with a newline stand for the line end and the word behind it."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self.learn, self.young = learn, {}

    def __missing__(self, x: str) -> bytes:
        ids = self.young.pop(x, None)
        if ids is not None:
            self[x] = ids
            return ids
        ids = self.learn(x)
        if len(x) <= _MEMO_CHARS:
            self.young[x] = ids
        return ids

    def thin(self) -> None:
        if len(self) > _MEMO_ENTRIES:
            self.young = dict(self)
            self.clear()
        elif len(self.young) > _MEMO_ENTRIES:
            self.young.clear()


class Encoder:
    """Whole texts to little-endian u32 ids, without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path not in _MEMO:
            _MEMO.clear()
            _MEMO[path] = Tokenizer.from_file(path), Memo(self._behind_blank), {}
        self.tokenizer, self.memo, self.bare = _MEMO[path]
        self.memo.learn = self._behind_blank
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.newline = self._whole("\n")
        self.cuts = self._byte_level() and len(self.newline) == 4

    def _byte_level(self) -> bool:
        """Whether pieces may be encoded alone: a byte-level BPE vocabulary that changes no character, puts no
        blank in front, cuts by the usual pattern and always merges alike."""
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        t = self.tokenizer
        if not isinstance(t.model, BPE) or not isinstance(t.pre_tokenizer, ByteLevel):
            return False
        cut = json.loads(t.pre_tokenizer.__getstate__())
        plain = cut.get("add_prefix_space") is False and cut.get("use_regex", True) is True
        always = not (t.model.dropout or t.model.continuing_subword_prefix or t.model.end_of_word_suffix)
        return plain and always and t.normalizer is None and t.truncation is None and t.padding is None

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _behind_blank(self, x: str) -> bytes:
        if x[0] == "\n":
            return self.newline + self._piece("", x[1:])
        return self._piece(" ", x)

    def _marks(self, x: str) -> bytes:
        ids = self.bare.get(x)
        if ids is None:
            if len(self.bare) > _MEMO_BARE:
                self.bare.clear()
            ids = self.bare[x] = self._piece("", x)
        return ids

    def _piece(self, blank: str, x: str) -> bytes:
        """Ids of a text without blanks (but the one in front) and newlines. Letters or digits and marks are
        pre-tokens that the library's model takes as they are; other pieces go through the whole tokenizer."""
        if x.isascii() and x.isalpha():
            return _ids(self.tokenize(BYTE_CHARACTERS[32] + x if blank else x))
        m = _PARTS.fullmatch(blank + x)
        if m is None:
            return self._whole(blank + x)
        word, marks = m.groups()
        if word and marks:
            return (self.memo[word[1:]] if blank else self._piece("", word)) + self._marks(marks)
        return _ids(self.tokenize(codecs.charmap_decode((blank + x).encode(), "strict", BYTE_CHARACTERS)[0]))

    def encode(self, texts: list[str]) -> list[bytes]:
        out, memo = [], self.memo
        for text in texts:
            if not text:
                out.append(b"")
            elif not self.cuts or irregular(text) or any(s in text for s in self.special):
                out.append(self._whole(text))
            else:
                first, *pieces = text.replace("\n", " \n").split(" ")
                out.append(self._piece("", first) + b"".join(map(memo.__getitem__, pieces)))
                memo.thin()
        return out


def _ids(tokens: list) -> bytes:
    return array("I", [t.id for t in tokens]).tobytes()


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank table, control bytes and data bytes of ids."""
    n = np.bincount(ids)
    found = np.flatnonzero(n)
    order = np.lexsort((found, -n[found]))
    rank = np.zeros(len(n), "<u4")
    rank[found[order]] = np.arange(len(found), dtype="<u4")
    values = rank[ids]
    size = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    four = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    four[: len(values)] = size
    control = (four.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= size[:, None]]
    return found[order].astype("<u4"), control, data


def unpack(ranks: np.ndarray, control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ids again: lengths by a table over control bytes, ids by the rank table."""
    size = LENGTHS[control].ravel()[:n]
    end = np.cumsum(size, dtype=np.int64)
    start = end - size
    values = data[start].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        values[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks[values]


def to_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment."""
    ranks, control, data = pack(ids)
    return b"".join(
        (
            _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(data), len(ranks)),
            ranks.tobytes(),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            counts.astype("<u8").tobytes(),
            control.tobytes(),
            data.tobytes(),
        )
    )


def segments(f: BinaryIO) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Document ids, token counts and token ids of a file's segments, one after the other."""
    while head := f.read(_HEAD.size):
        magic, n_docs, n_ids, n_data, n_ranks = _HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a token file")

        def take(kind: str, n: int) -> np.ndarray:
            return np.frombuffer(f.read(n * np.dtype(kind).itemsize), kind, n)

        ranks, keys, null, counts = take("<u4", n_ranks), take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
        control = take("u1", -(-n_ids // 4))
        ids = unpack(ranks, control, take("u1", n_data), n_ids)
        yield [None if z else int(k) for k, z in zip(keys, null, strict=True)], counts, ids


def write_tokens(
    docs: DataFrame, path: str, tokenizer_file: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0,
    files: int | None = None, segment: int = SEGMENT,
) -> list[dict]:
    """Write docs' ids under path and return the files' list: name, docs, tokens, in ascending order.
    One row a file reaches the driver."""
    from .common import partitions, prepare

    spark = prepare(docs.sparkSession)
    hashed = docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t")]
    ordered = hashed.repartitionByRange(files or partitions(spark), *order).sortWithinPartitions(*order, "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        place, name = context.partitionId(), f"part-{context.partitionId():06d}.rgv"
        store, folder = fs.FileSystem.from_uri(path)
        own = f"{folder}/_{name}.{context.taskAttemptId()}"
        encoder, keys, parts, counts = Encoder(tokenizer_file), [], [], []
        last = np.array([end_id], "<u4").tobytes()
        docs = tokens = held = 0

        def flush() -> None:
            nonlocal docs, tokens, held
            if keys:
                f.write(to_bytes(keys, np.array(counts), np.frombuffer(b"".join(parts), "<u4")))
            docs, tokens, held = docs + len(keys), tokens + held, 0
            for x in (keys, parts, counts):
                x.clear()

        with store.open_output_stream(own) as f:
            for batch in batches:
                all_keys, texts = (batch.column(c).to_pylist() for c in ("k", "t"))
                for k, ids in zip(all_keys, encoder.encode(texts), strict=True):
                    keys.append(k)
                    parts += (ids, last)
                    counts.append(len(ids) // 4 + 1)
                    held += counts[-1]
                    if held >= segment:
                        flush()
            flush()
        if not docs:
            store.delete_file(own)
            return
        store.move(own, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"part": [place], "name": [name], "docs": [docs], "tokens": [tokens]})

    made = ordered.mapInArrow(write, "part long, name string, docs long, tokens long").collect()
    return [x.asDict() for x in sorted(made, key=lambda x: x.part)]


def read_tokens(spark: SparkSession, path: str, listed: list[dict]) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids (binary, little-endian u32)."""
    from .common import prepare

    prepare(spark)
    rows, start = [], 0
    for x in listed:
        rows.append((x["name"], start))
        start += x["tokens"]
    files = spark.createDataFrame(rows, "name string, start long")
    files = files.repartition(max(1, len(rows)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_stream(f"{folder}/{name}") as f:
                    for keys, counts, ids in segments(f):
                        ends = np.cumsum(counts, dtype=np.int64)
                        begins = ends - counts.astype(np.int64)
                        for at in range(0, len(keys), 256):
                            span = range(at, min(at + 256, len(keys)))
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array(keys[at : at + 256], pa.int64()),
                                    pa.array(begins[at : at + 256] + start),
                                    pa.array(counts[at : at + 256].astype(np.int64)),
                                    pa.array([ids[begins[k] : ends[k]].tobytes() for k in span], pa.binary()),
                                ],
                                ["doc_id", "start", "n_tokens", "ids"],
                            )
                        start += int(ends[-1])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def digest(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Write docs, read them back: doc_id, start, n_tokens, ids_crc32."""
    from .common import scratch

    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    tokens = read_tokens(spark, path, write_tokens(docs, path, tokenizer_file))
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table, tokenizer_path

    return digest(table(spark, sf_dir, "documents"), tokenizer_path())
