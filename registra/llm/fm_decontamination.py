"""Benchmark decontamination with an FM-index per shard of the training data.

A shard is what one task reads (texts of at most HELD bytes, or one text; a task with more makes several). Words
that no benchmark item of the block has become separators, and so do runs of other words that are shorter
than the shortest window: no window can lie in them. Over what is left the shard builds its
Burrows-Wheeler transform, a wavelet tree of it for ranks, and suffix positions at every 8th place.
All windows are searched backward together; occurrences are located by walking to a sampled suffix, and
their word ranges are merged into removal spans.

The benchmark is a stated query set: it is sent out in blocks of at most BLOCK words (a longer item is a block), which
lie on the executors' disks; a task reads one at a time, whatever the number, and the driver holds one, too.

Defined results: null and empty texts have no words and are clean; an item without words, or with a null
id, has no window; items with the same id are one item of several texts; repeated documents are judged
one by one; columns other than those named are ignored; an empty benchmark leaves everything clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, prepare, table, utf8

WINDOW = 13
SHARE = 20  # contaminated: SHARE * n_hit >= n_words
SAMPLE = 8
HELD = 24 << 20
BLOCK = 1 << 20


def item_words(text: str | None) -> list[bytes]:
    return utf8(text).translate(ALNUM).split()


def windows(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


class WaveletTree:
    """Ranks and symbols of an integer sequence, level by level from the highest bit, zeros first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits = len(symbols), bits
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            zeros = int(len(bit) - bit.sum())
            self.levels.append((words, before, zeros))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        words, before, _ = self.levels[level]
        k = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[k] + np.bitwise_count(words[k] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        low, high = np.zeros_like(i), i
        for level in range(self.bits):
            zeros = self.levels[level][2]
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at places i and their ranks there."""
        symbol, low, high = np.zeros_like(i), np.zeros_like(i), i
        for level in range(self.bits):
            words, _, zeros = self.levels[level]
            one = (words[high >> 6] >> (high & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            symbol = symbol << 1 | one
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return symbol, high - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the end sorts first."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    step = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - step)] = rank[step:]
        key = rank * (n + 2) + behind
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(new)
        if n == 0 or rank[order[-1]] == n:
            return order
        step *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int):
        """text: symbols from 1 to sigma - 1, 0 for separators. In the index all are one more, and the end
        has symbol 0."""
        text = np.append(text + 1, 0)
        sigma += 1
        order = suffix_array(text)
        bwt = text[order - 1]
        self.tree = WaveletTree(bwt, max(1, int(sigma - 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.sampled = order % SAMPLE == 0
        self.before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.places = order[self.sampled]
        self.n = len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases (padded at the front: the last symbol is in the last column)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        width = phrases.shape[1]
        for k in range(width):
            alive = alive[(lengths[alive] > k) & (high[alive] > low[alive])]
            if not len(alive):
                break
            c = phrases[alive, width - 1 - k].astype(np.int64) + 1
            low[alive] = self.first[c] + self.tree.rank(c, low[alive])
            high[alive] = self.first[c] + self.tree.rank(c, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, walked = np.zeros(len(rows), np.int64), 0
        todo, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            there = self.sampled[at]
            out[todo[there]] = self.places[self.before[at[there]]] + walked
            todo, at = todo[~there], at[~there]
            symbol, rank = self.tree.step(at)
            at = self.first[symbol] + rank
            walked += 1
        return out


class Block:
    """Items' windows as ids: the query set or a part of it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, words in items:
            for w in windows(words, width):
                key = tuple(self.ids.setdefault(x, len(self.ids) + 1) for x in w)
                found.setdefault(key, set()).add(name)
        self.items = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(k) for k in found], np.int64)
        self.least = int(self.lengths.min()) if found else 0
        self.phrases = np.zeros((len(found), width), np.int32)
        for row, k in zip(self.phrases, found, strict=True):
            row[width - len(k) :] = k

    def runs(self, words: list[bytes]) -> list[tuple[int, np.ndarray]]:
        """Where windows can lie: runs (first word, ids) of known words."""
        ids = np.fromiter(map(self.ids.get, words, _zeros()), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]]).astype(np.int8)))
        return [(a, ids[a:b]) for a, b in edge.reshape(-1, 2).tolist() if b - a >= self.least]


def _zeros() -> Iterator[int]:
    while True:
        yield 0


def search_shard(block: Block, runs: list[tuple[int, int, np.ndarray]]) -> Iterator[tuple[int, int, int, int]]:
    """runs: (document, first word, ids). Occurrences: document, first word, length, window."""
    sizes = np.array([len(x) + 1 for *_, x in runs])
    starts = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), np.int32)
    for at, (_, _, ids) in zip(starts.tolist(), runs, strict=True):
        text[at : at + len(ids)] = ids
    index = FMIndex(text, len(block.ids) + 1)
    low, high = index.search(block.phrases, block.lengths)
    n = high - low
    window = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    for a in range(0, len(rows), 1 << 20):
        place = index.locate(rows[a : a + (1 << 20)])
        w = window[a : a + (1 << 20)]
        run = np.searchsorted(starts, place, side="right") - 1
        for r, p, k in zip(run.tolist(), (place - starts[run]).tolist(), w.tolist(), strict=True):
            yield runs[r][0], runs[r][1] + p, int(block.lengths[k]), k


def query_blocks(benchmark: DataFrame, width: int) -> Iterator[Block]:
    items, n = [], 0
    for x in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if x.item_id is None:
            continue
        items.append((x.item_id, item_words(x.text)))
        n += len(items[-1][1])
        if n >= BLOCK:
            yield Block(items, width)
            items, n = [], 0
    if items:
        yield Block(items, width)


SCHEMA = (
    "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean,"
    " items array<string>, spans array<struct<start:long,end:long>>"
)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), width: int = WINDOW) -> DataFrame:
    """The columns keep of docs and n_words, n_hit, n_items, items_sha256, contaminated, items, spans
    (merged word ranges, end excluded)."""
    spark = prepare(docs.sparkSession)
    sent = [spark.sparkContext.broadcast(b) for b in query_blocks(benchmark, width)]
    rows = docs.select(*keep, F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        texts: list[str | None] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            counts = [] if sent else [len(item_words(t)) for t in texts]
            for k, x in enumerate(sent):
                block = x.value
                runs: list[tuple[int, int, np.ndarray]] = []
                for doc, text in enumerate(texts):
                    words = item_words(text)
                    if not k:
                        counts.append(len(words))
                    runs += [(doc, at, ids) for at, ids in block.runs(words)]
                for doc, at, n, w in search_shard(block, runs) if runs else ():
                    spans.setdefault(doc, []).append((at, at + n))
                    items.setdefault(doc, set()).update(block.items[w])
                if len(sent) > 1:
                    del block
                    x.__dict__.pop("_value", None)  # read again from disk for the next shard
            base = 0
            for b in held:
                out: list[list] = [[] for _ in range(7)]
                for doc in range(base, base + b.num_rows):
                    merged: list[list[int]] = []
                    for a, z in sorted(spans.get(doc, ())):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], z)
                        else:
                            merged.append([a, z])
                    named = sorted(items.get(doc, ()))
                    hit = sum(z - a for a, z in merged)
                    row = (
                        counts[doc], hit, len(named), hashlib.sha256(",".join(named).encode()).hexdigest(),
                        hit > 0 and SHARE * hit >= counts[doc], named, [{"start": a, "end": z} for a, z in merged],
                    )
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                base += b.num_rows
                made = [
                    pa.array(c, t)
                    for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()),
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, *made],
                    [*b.schema.names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
                )
            held.clear()
            texts.clear()

        for batch in batches:
            own = batch.column("_text").to_pylist()
            texts += own
            size += sum(len(t or "") for t in own)
            held.append(batch.drop_columns(["_text"]))
            if size >= HELD:
                yield from flush()
                size = 0
        yield from flush()

    return rows.mapInArrow(run, f"{kinds}, {SCHEMA}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated documents."""
    named = [F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(docs.columns)]
    own = tuple(f"_c{k}" for k in range(len(named)))
    marked = decontaminate(docs.select(*named, "text"), benchmark, keep=own)
    return marked.filter(~F.col("contaminated")).select(*[F.col(a).alias(c) for a, c in zip(own, docs.columns, strict=True)])


def op6_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS p
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (
  SELECT DISTINCT n FROM win
), cand AS (
  SELECT k, i, n, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hit AS (
  SELECT c.k, c.i, c.n, win.item FROM cand c JOIN win ON c.p = win.p AND c.n = win.n
), covered AS (
  SELECT k, count(DISTINCT x) AS n FROM (SELECT DISTINCT k, unnest(range(i, i + n)) AS x FROM hit) GROUP BY k
), named AS (
  SELECT k, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (k) LEFT JOIN named USING (k)
"""
