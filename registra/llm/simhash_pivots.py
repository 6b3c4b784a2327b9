"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint has a bit for each of the 64 bits of its shingles' hashes: 1 if more than half of
them have it. Distinct fingerprints get, once, a table of Hamming distances to PIVOTS unrelated reference
fingerprints, which is stored beside them and goes along wherever pairs are looked at: a pair is discarded
when any coordinate differs by more than DISTANCE, as no distance changes by more than the pair's own;
survivors are verified bit by bit.

The pairs come from a second use of distances: to a base pivot and to the base with one bit turned, which
differ by one up or down as the fingerprint's bit is. A pair within 3 bits leaves at least 3 of 6 segments
alone, and there those differences are equal; so pairs meet in a cell of one of the 20 choices of 3
segments, keyed by the differences (that is, by equal bits). No link is lost and no pair is ever enumerated
outside a cell. Cells give spanning forests of their links, not all pairs. Cells of over CELL fingerprints
are dealt in parts, two by two. Cells are sorted on disk and read one after the other, so that a task holds one
part of a cell (or a few thousand fingerprints of small ones).

Defined results: null and empty texts have fingerprint zero; repeated rows and equal texts share one
fingerprint; a null id takes part and is smallest only where no other id is; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, partitions, prepare, table, utf8, written
from .components import components

SEED = 42
WIDTH = 3
DISTANCE = 3
SEGMENTS = np.array_split(np.arange(64), 6)
CHOICES = list(combinations(range(6), 3))
CELL = 4096


def _pivot(name: str) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little")


BASE = np.uint64(_pivot("base"))
TURNED = BASE ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
PIVOTS = 16
OTHERS = np.array([_pivot(f"pivot {k}") for k in range(PIVOTS)], np.uint64)


def fingerprint(data: bytes, width: int = WIDTH) -> int:
    """Of UTF-8 bytes; signed 64 bits."""
    from xxhash import xxh64_intdigest

    w = data.translate(LOWER).split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < width else map(b" ".join, zip(*(w[k:] for k in range(width)), strict=False))
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(1, len(w) - width + 1))
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        count += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, h (the text's hash) and fp (long) of docs' texts."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(utf8(t), width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(fps, pa.int64())], ["doc_id", "h", "fp"])

    return rows.mapInArrow(run, "doc_id long, h long, fp long")


def distances(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ pivots[None, :])


def _tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints with their tables: PIVOTS bytes each."""
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False)
        t = distances(fp.view(np.uint64), OTHERS).astype(np.uint8)
        flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PIVOTS), len(fp), [None, pa.py_buffer(t.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(fp), b.column("least"), flat.cast(pa.binary())], ["fp", "least", "t"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp, t = b.column("fp").to_numpy(zero_copy_only=False), b.column("t")
        u = fp.view(np.uint64)
        nearer = distances(u, TURNED) < distances(u, np.array([BASE]))
        part = [np.zeros(len(u), np.int64) for _ in SEGMENTS]
        for k, s in enumerate(SEGMENTS):
            for bit in s:
                part[k] = part[k] << 1 | nearer[:, bit]
        for c, choice in enumerate(CHOICES):
            key = np.full(len(u), c, np.int64)
            for k in choice:
                key = key << len(SEGMENTS[k]) | part[k]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), t], ["cell", "fp", "t"])


class Tally:
    """Pairs looked at, discarded by the table, linked."""

    def __init__(self) -> None:
        self.pairs = self.discarded = self.linked = 0

    def near(self, a: np.ndarray, ta: np.ndarray, b: np.ndarray, tb: np.ndarray) -> np.ndarray:
        """Of pairs, side by side: which pass the table and are near."""
        alive = np.flatnonzero((np.abs(ta - tb) <= DISTANCE).all(axis=1))
        out = np.zeros(len(a), bool)
        out[alive] = np.bitwise_count(a[alive] ^ b[alive]) <= DISTANCE
        self.count(len(a), len(alive), int(out.sum()))
        return out

    def count(self, pairs: int, alive: int, linked: int) -> None:
        self.pairs += pairs
        self.discarded += pairs - alive
        self.linked += linked


def forest(fp: np.ndarray, t: np.ndarray, tally: Tally) -> list[tuple[int, int]]:
    """Edges (indexes) that connect what links connect, by growing from one fingerprint after another."""
    rest, edges = np.arange(1, len(fp)), []
    front = np.array([0])
    while len(rest):
        if not len(front):
            front, rest = rest[:1], rest[1:]
            continue
        now, front = front[:512], front[512:]
        alive = np.ones((len(now), len(rest)), bool)
        for k in range(t.shape[1]):
            alive &= np.abs(t[now, None, k] - t[None, rest, k]) <= DISTANCE
        i, j = np.nonzero(alive)
        near = np.bitwise_count(fp[now[i]] ^ fp[rest[j]]) <= DISTANCE
        tally.count(alive.size, len(i), int(near.sum()))
        i, j = i[near], j[near]
        if len(j):
            j, first = np.unique(j, return_index=True)
            edges += zip(now[i[first]].tolist(), rest[j].tolist(), strict=True)
            front = np.concatenate([front, rest[j]])
            rest = np.delete(rest, j)
    return edges


SMALL = 16
HELD = 1 << 15


def _edges(batches: Iterator[pa.RecordBatch], tally: Tally | None = None) -> Iterator[pa.RecordBatch]:
    """The links of whole cells, as forests. Rows come sorted by cell and part; whole groups are taken a few thousand
    rows at a time."""
    tally = tally or Tally()
    held: list[list[np.ndarray]] = []
    size = 0

    def groups(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell, part, fp, t = rows
        new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
        start = np.flatnonzero(new)
        sizes = np.diff(np.append(start, len(fp)))
        edges: list[np.ndarray] = []
        small, group = np.repeat(sizes, sizes) <= SMALL, np.cumsum(new)
        for step in range(1, min(SMALL, len(fp))):
            i = np.flatnonzero(small[:-step] & (group[step:] == group[:-step]))
            if not len(i):
                break
            near = tally.near(fp[i], t[i], fp[i + step], t[i + step])
            edges.append(np.stack([fp[i][near], fp[i + step][near]]))
        for s, n in zip(start[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            own, at = np.unique(fp[s : s + n], return_index=True)
            if found := forest(own, t[s : s + n][at], tally):
                edges.append(own[np.array(found).T])
        if edges:
            u, v = np.unique(np.concatenate(edges, axis=1), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        t = np.frombuffer(b"".join(b.column("t").to_pylist()), np.uint8).reshape(-1, PIVOTS).astype(np.int8)
        held.append([b.column("cell").to_numpy(), b.column("part").to_numpy(), b.column("fp").to_numpy().view(np.uint64), t])
        size += b.num_rows
        if size < HELD:
            continue
        rows = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from groups([x[:cut] for x in rows])
        held, size = [[x[cut:] for x in rows]], len(rows[0]) - cut
    if size:
        yield from groups([np.concatenate(x) for x in zip(*held, strict=True)])


def pivot_figures(distinct: DataFrame) -> dict[str, int]:
    """How many pairs the cells of distinct fingerprints (fp, least, t) give, how many the tables discard and how many
    are links: pairs, discarded, linked. For reports; it does the work of links again."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for _ in _edges(batches, tally):
            pass
        yield pa.RecordBatch.from_pydict({"pairs": [tally.pairs], "discarded": [tally.discarded], "linked": [tally.linked]})

    out = _dealt(distinct).mapInArrow(count, "pairs long, discarded long, linked long")
    return out.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "discarded", "linked")]).first().asDict()


def _dealt(distinct: DataFrame) -> DataFrame:
    """cell, part, fp, t, sorted by cell and part, each part of a cell whole in one partition."""
    spark = distinct.sparkSession
    cells = written(distinct.select("fp", "t").mapInArrow(_cells, "cell long, fp long, t binary"), "cells")
    hot = cells.groupBy("cell").count().filter(F.col("count") > CELL)
    parts = F.ceil(F.col("count") / F.lit(CELL / 2)).cast("int")
    hot = hot.select("cell", parts.alias("parts"))
    dealt = cells.join(hot, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda x: F.least(x, F.col("own")) * F.col("parts") + F.greatest(x, F.col("own")),
    )
    dealt = dealt.withColumn("own", own).select("cell", F.explode(pairs).alias("part"), "fp", "t")
    return dealt.repartition(partitions(spark), "cell", "part").sortWithinPartitions("cell", "part")


def links(distinct: DataFrame) -> DataFrame:
    """Distinct fingerprints with tables (fp, t) to edges (u, v) that connect all that are within DISTANCE bits."""
    return _dealt(distinct).mapInArrow(_edges, "u long, v long")


def tabled(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints: fp, least (the smallest doc_id), t (the pivot table), written."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    return written(distinct.mapInArrow(_tabled, "fp long, least long, t binary"), "fps")


def groups(prints: DataFrame) -> DataFrame:
    """Fingerprints' components: fp, root (the component's smallest fingerprint), component_id."""
    distinct = tabled(prints)
    roots = components(links(distinct)).withColumnRenamed("u", "fp")
    named = distinct.select("fp", "least").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, h, fingerprint (16 hex digits), root and component_id, a row for each row of docs."""
    prints = written(fingerprints(docs, width), "prints")
    out = prints.join(groups(prints), "fp")
    return out.select(
        "doc_id", "h", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id"
    )


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without all but the first (by id, then text hash) of each group; equal rows count as one."""
    found = near_duplicates(docs, width)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("x"))
    key = lambda d, h: F.concat_ws("/", F.coalesce(d.cast("string"), F.lit("null")), h.cast("string"))
    first = first.select(key(F.col("x.doc_id"), F.col("x.h")).alias("_key"))
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.withColumn("_key", key(F.col("doc_id").cast("bigint"), h))
    return keyed.join(first, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")


def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
