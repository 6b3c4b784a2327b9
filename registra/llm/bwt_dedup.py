"""Exact substring dedup by merging shard Burrows-Wheeler transforms.

Every byte covered by a SPAN-byte string that also starts earlier goes. Documents are ordered by id.

1. Parse. In every window of SPAN bytes the k-gram with the smallest hash is the window's anchor (the
   leftmost of equal ones), so that equal windows have equal anchors at equal places. A document becomes
   runs of windows with the same anchor; a run's context is its windows' bytes. Anchors that occur once
   can't be in a repeated window.
2. Dictionary. As in prefix-free parsing, equal contexts are one entry with several occurrences (equal: the
   same anchor and 128 bits of hash over the bytes); all windows of the occurrences after the first start
   earlier, there. Tasks combine occurrences before the shuffle, so that a passage that very many documents
   share is few rows. An anchor with one entry ends here, as no other entry can have its windows.
3. The entries of the other anchors are dealt by anchor into buckets, and those of a bucket into shards.
   (An anchor with more than DEEP entries is dealt by a second anchor, with hashes of its own, too.)
   Each shard gets the Burrows-Wheeler transform of its entries over an alphabet of STRIDE-byte blocks
   (an entry is read as STRIDE strings of blocks, one for each phase). The transforms are merged by
   refining their interleave: round after round the blocks that stand before the interleaved rows are
   stably dealt into buckets, which sorts the rows by one block more; no suffix is compared or sorted
   again. A row's boundary appears in the round that is one more than its common prefix with the row
   before. After SPAN / STRIDE rounds rows without a boundary between them form a repeated interval; its
   bytes are compared, and all but its earliest start are removed.

Memory: a task of step 2 holds 41 bytes for each occurrence of its share of the anchors that is left after
combining; a task of step 3 holds one bucket.

Defined results: null and empty texts have 0 bytes and keep the empty string; texts under SPAN bytes lose
nothing; where ids are null or repeated, documents are ordered by (id, nulls first; text hash; text), and
exactly repeated rows count as one after the other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, prepare, table, utf8, written

SPAN = 100
GRAM = 32
STRIDE = 25
CHUNK = 1 << 20  # bytes hashed at a time
BUCKET = 1 << 20  # bytes of contexts in a bucket
SHARDS = 4
DEEP = 1_000  # entries of an anchor
COMMON = 8  # occurrences in a chunk that make a context worth remembering
REMEMBERED = 200_000
_PLACE = np.uint64((1 << 24) - 1)
#: Odd multipliers of the polynomial hashes: one after the other is tried where two blocks share a hash.
ROOTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _byte_values() -> np.ndarray:
    raw = b"".join(hashlib.sha256(bytes([k])).digest()[:8] for k in range(256))
    return np.frombuffer(raw, "<u8").astype(np.uint64)


BYTE = _byte_values()


def _powers(root: int, n: int) -> np.ndarray:
    out = np.full(n, root, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Polynomial hashes, modulo 2 ** 64, of all substrings of data."""

    def __init__(self, data: np.ndarray, root: int = ROOTS[0]):
        n = len(data)
        self.back = _powers(pow(root, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * _powers(root, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def runs(data: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM, root: int = ROOTS[0]) -> tuple[np.ndarray, ...]:
    """Anchor, first and last window of the runs of data, documents end to end."""
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return none, none, none
    hashes = Hashes(data, root)
    h = _mix((hashes.sums[gram:] - hashes.sums[:-gram]) * hashes.back[: len(data) - gram + 1])
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, step = span - gram + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    valid = np.ones(len(low), bool)
    for e in ends.tolist():
        valid[max(0, e - span + 1) : e] = False
    new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])]))
    last = np.append(new[1:], len(low)) - 1
    first, last = new[valid[new]], last[valid[new]]
    return h[(low[first] & _PLACE).astype(np.int64)].view(np.int64), first, last


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(document, offset, bytes): texts longer than a chunk are cut with an overlap of SPAN - 1 bytes, so
    that every window is in one piece, and whole."""
    for k, t in enumerate(texts):
        at = 0
        while at == 0 or at + SPAN - 1 < len(t):
            yield k, at, t[at : at + 4 * CHUNK + SPAN - 1]
            at += 4 * CHUNK


def contexts(raw: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """128 bits of hash (two columns) of the bytes of each run's windows."""
    from xxhash import xxh3_128_digest

    spans = zip(first.tolist(), (last + SPAN).tolist(), strict=True)
    return np.frombuffer(b"".join([xxh3_128_digest(raw[a:z]) for a, z in spans]), "<i8").reshape(-1, 2)


def _grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs (anchor, c, d, doc, run): those whose anchor repeats, sorted, and among them who is the first of its
    anchor and who the first of its context."""
    anchor = columns[0]
    order = np.argsort(anchor, kind="stable")
    s = anchor[order]
    same = s[1:] == s[:-1]
    again = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(s) else order
    a, c, d, doc, run = (x[again] for x in columns[:5])
    again = again[np.lexsort((run, doc, d, c, a))]
    a, c, d = (x[again] for x in columns[:3])
    new = np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]
    first = new | np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])])[: len(a)]
    return again, new, first


RUNS = ["anchor", "c", "d", "doc", "run", "copy"]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, text to anchor, c, d (the context's hash), doc, run (first window << 8 | windows - 1), copy.

    Occurrences of one context are combined within a chunk: all but the first are copies. Contexts that a chunk has
    COMMON times are remembered, so that the task's later chunks are combined with it: an occurrence behind the
    remembered one is a copy, an earlier one takes its place."""
    known: dict[tuple[int, int, int], tuple[int, int]] = {}
    listed = np.zeros(0, np.int64)

    def flush(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        nonlocal listed
        size = np.array([len(x) for *_, x in held])
        ends = np.cumsum(size)
        raw = b"".join(x for *_, x in held)
        anchor, first, last = runs(np.frombuffer(raw, np.uint8), ends)
        own = np.searchsorted(ends, first, side="right")
        doc = np.array([d for d, *_ in held], np.int64)[own]
        start = first - (ends - size)[own] + np.array([a for _, a, _ in held])[own]
        run = start << 8 | (last - first)
        c, d = contexts(raw, first, last).T
        at, _, new = _grouped([anchor, c, d, doc, run])
        copy = np.zeros(len(anchor), bool)
        copy[at[~new]] = True
        leaders = np.flatnonzero(new)
        times = np.diff(np.append(leaders, len(at)))
        often = set(at[leaders[times >= COMMON]].tolist())
        met = set(np.flatnonzero((listed[np.searchsorted(listed, c) % len(listed)] == c) & ~copy).tolist()) if len(listed) else set()
        for i in sorted(often | met):
            key, here = (int(anchor[i]), int(c[i]), int(d[i])), (int(doc[i]), int(run[i]))
            before = known.get(key)
            if before is not None and before < here:
                copy[i] = True
            elif before is not None or i in often and len(known) < REMEMBERED:
                known[key] = here
        if len(known) > len(listed):
            listed = np.sort(np.fromiter((k[1] for k in known), np.int64, len(known)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, c, d, doc, run, copy)], RUNS)

    held, size = [], 0
    for b in batches:
        docs = b.column("doc").to_pylist()
        for k, at, x in _pieces([utf8(t) for t in b.column("text").to_pylist()]):
            if len(x) >= SPAN:
                held.append((docs[k], at, x))
                size += len(x)
            if size >= CHUNK:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs to the dictionary: doc, run, anchor, copy (its context was there before), deep. First occurrences are left
    out where their anchor has no other entry. Runs that are copies already are passed on."""
    got = []
    for b in batches:
        copy = b.column("copy").to_numpy(zero_copy_only=False)
        k = np.flatnonzero(copy)
        if len(k):
            doc, run, anchor = (b.column(x).to_numpy()[k] for x in ("doc", "run", "anchor"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(run), pa.array(anchor), pa.array(np.ones(len(k), bool)), pa.array(np.zeros(len(k), bool))], ENTRIES
            )
        k = np.flatnonzero(~copy)
        got.append([b.column(x).to_numpy()[k] for x in RUNS[:5]])
    if not got:
        return
    columns = [np.concatenate(x) for x in zip(*got, strict=True)]
    del got
    at, new, first = _grouped(columns)
    group = np.cumsum(new) - 1
    entries = np.bincount(group, weights=first) if len(group) else np.zeros(0)
    keep = ~first | (entries[group] > 1)
    for a in range(0, len(keep), 1 << 16):
        k = np.flatnonzero(keep[a : a + (1 << 16)]) + a
        anchor, _, _, doc, run = (x[at[k]] for x in columns)
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(run), pa.array(anchor), pa.array(~first[k]), pa.array(entries[group[k]] > DEEP)], ENTRIES)


ENTRIES = ["doc", "run", "anchor", "copy", "deep"]


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with wanted runs to entries: anchor (with the second anchor in it where deep), doc, start, context."""
    for b in batches:
        out: list[list] = [[], [], [], []]

        def put(anchor: int, doc: int, start: int, context: bytes, out: list[list] = out) -> None:
            for column, v in zip(out, (anchor, doc, start, context), strict=True):
                column.append(v)

        for doc, text, wanted in zip(*(b.column(c).to_pylist() for c in ("doc", "text", "wanted")), strict=True):
            raw = utf8(text)
            for x in wanted:
                start, n = x["run"] >> 8, (x["run"] & 255) + SPAN
                context = raw[start : start + n]
                if not x["deep"]:
                    put(x["anchor"], doc, start, context)
                    continue
                data = np.frombuffer(context, np.uint8)
                second, first, last = runs(data, np.array([n]), root=ROOTS[1])
                key = _mix(np.array([x["anchor"]], np.int64).view(np.uint64) ^ _mix(second.view(np.uint64))).view(np.int64)
                for k, a, z in zip(key.tolist(), first.tolist(), last.tolist(), strict=True):
                    put(k, doc, start + a, context[a : z + SPAN])
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
            ["anchor", "doc", "start", "context"],
        )


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable argsort of numbers from 0 on, 16 bits at a time, for which numpy has a radix sort."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    most, shift = int(x.max(initial=0)), 16
    while most >> shift:
        order = order[np.argsort((x[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


class Shard:
    """Rows (positions) of a shard's contexts in suffix order, and the blocks before them.

    at: the bucket's position for each row, or -1 for a terminator; before: the symbol of the block that
    precedes the row, 0 where none does.
    """

    def __init__(self, symbol: np.ndarray, follow: np.ndarray, head: np.ndarray, own: np.ndarray, ends: int):
        """symbol: of the block at each position of the bucket; follow: the position a block further, or
        -1; head: the symbol a block before; own: this shard's positions; ends: its strings."""
        local = np.full(len(symbol) + 1, -1, np.int64)
        local[own] = np.arange(len(own))
        after = local[follow[own]]  # -1 stands for a terminator
        one = symbol[own].astype(np.int64)
        rank = one
        depth = 1
        here = np.arange(len(own))

        def behind(rank: np.ndarray, blocks: int) -> np.ndarray:
            at = here
            for _ in range(blocks):
                at = np.where(at >= 0, after[at], -1)
            return np.where(at >= 0, rank[at], 0)

        def ranked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = stable_order(b)
            order = order[stable_order(a[order])]
            x, y = a[order], b[order]
            out = np.empty(len(order), np.int64)
            out[order] = np.cumsum(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(x)])
            return out, order

        order = stable_order(rank)
        while 2 * depth <= SPAN // STRIDE:
            rank, order = ranked(rank, behind(rank, depth))
            depth *= 2
        if depth < SPAN // STRIDE:
            rank, order = ranked(rank, behind(one, depth))
        # Terminators come first; the block before a terminator is the last of its string.
        last = own[after < 0]
        self.at = np.concatenate([np.full(ends, -1, np.int64), own[order]])
        lone = ends - len(last)  # strings without any block: nothing is before their terminators
        self.before = np.concatenate([symbol[last], np.zeros(lone, symbol.dtype), head[own[order]]])


def interleave(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged rows: shard of each, and the common prefix with the row before, in blocks (at most rounds).

    A shard's rows keep their order, so that the shard numbers say all. Before the first round they stand
    shard after shard."""
    z = np.repeat(np.arange(len(shards), dtype=np.int8), [len(s.before) for s in shards])
    prefix = np.full(len(z), rounds, np.int8)
    prefix[:1] = 0
    group = np.zeros(len(z), np.int64)
    for step in range(rounds):
        before = np.empty(len(z), np.int32)
        for k, s in enumerate(shards):
            before[z == k] = s.before
        order = stable_order(before)
        z, before, group = z[order], before[order], group[order]
        new = np.ones(len(z), bool)
        new[1:] = (before[1:] != before[:-1]) | (group[1:] != group[:-1])
        prefix[new & (prefix == rounds)] = step
        group = np.cumsum(new)
    return z, prefix


def repeated(contexts: list[bytes], order: np.ndarray) -> np.ndarray:
    """Positions, in the contexts end to end, whose SPAN bytes also start at a position of a smaller order
    (an array over positions). Where two blocks share a hash, other hashes are taken."""
    for root in ROOTS:
        found = _repeated(contexts, order, root)
        if found is not None:
            return found
    raise ArithmeticError(f"blocks share a hash with each of {len(ROOTS)} multipliers")


def _repeated(contexts: list[bytes], order: np.ndarray, root: int) -> np.ndarray | None:
    """Contexts are dealt into shards, and the shards' transforms are merged; None if intervals turn out unequal."""
    size = np.array([len(x) for x in contexts])
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    n = len(data)
    own = np.repeat(np.arange(len(contexts)), size)
    left = ends[own] - np.arange(n)  # bytes to the context's end
    hashes = Hashes(data, root)
    block = np.zeros(n, np.uint64)
    full = np.flatnonzero(left >= STRIDE)
    block[full] = _mix(hashes.of(full, full + STRIDE))
    symbol = np.zeros(n, np.int32)
    symbol[full] = np.unique(block[full], return_inverse=True)[1] + 1
    follow = np.where(left >= 2 * STRIDE, np.arange(n) + STRIDE, -1)
    head = np.zeros(n, np.int32)
    inside = size[own] - left >= STRIDE
    head[inside] = symbol[np.flatnonzero(inside) - STRIDE]
    shard_of = np.minimum(np.arange(len(contexts)) * SHARDS // len(contexts), SHARDS - 1)
    of_byte = shard_of[own]
    shards = []
    for k in range(SHARDS):
        mine = full[of_byte[full] == k]
        strings = int((shard_of == k).sum()) * STRIDE
        shards.append(Shard(symbol, follow, head, mine, strings))
    z, prefix = interleave(shards, SPAN // STRIDE)
    at = np.empty(len(z), np.int64)
    for k, s in enumerate(shards):
        at[z == k] = s.at
    interval = np.cumsum(prefix < SPAN // STRIDE)
    window = (at >= 0) & (left[np.maximum(at, 0)] >= SPAN)
    at, interval = at[window], interval[window]
    place = np.lexsort((order[at], interval))
    at, interval = at[place], interval[place]
    first = np.concatenate([[True], interval[1:] != interval[:-1]])[: len(at)]
    leader = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
    again = np.flatnonzero(~first)
    found = []
    for a in range(0, len(again), 1 << 15):
        i = again[a : a + (1 << 15)]
        span = np.arange(SPAN)
        equal = (data[at[i][:, None] + span] == data[leader[i][:, None] + span]).all(axis=1)
        if not equal.all():
            return None
        found.append(at[i])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's contexts, anchors whole, to removed windows (doc, start, end), runs joined."""
    held: list[tuple[int, int, int, bytes]] = []

    def bucket(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        rows.sort(key=lambda x: x[1:3])
        contexts = [x[3] for x in rows]
        size = np.array([len(x) for x in contexts])
        base = np.cumsum(size) - size
        doc = np.array([x[1] for x in rows], np.int64)
        start = np.array([x[2] for x in rows], np.int64)
        hit = np.sort(repeated(contexts, np.arange(int(size.sum()))))
        own = np.searchsorted(base, hit, side="right") - 1
        d, s = doc[own], start[own] + hit - base[own]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)])[: len(d)]
        i = np.flatnonzero(new)
        j = np.append(i[1:], len(d))[: len(i)] - 1
        return pa.RecordBatch.from_arrays([pa.array(d[i]), pa.array(s[i]), pa.array(s[j] + SPAN)], ["doc", "start", "end"])

    size, last = 0, None
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "doc", "start", "context")), strict=True):
            if size >= BUCKET and row[0] != last:
                yield bucket(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
            last = row[0]
    if held:
        yield bucket(held)


def numbered(docs: DataFrame) -> DataFrame:
    """doc (a number in the documents' order), doc_id and text. Where ids are unique they are the numbers."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    worst = rows.groupBy("doc_id").count().agg(F.max("count").alias("n"), F.max(F.col("doc_id").isNull()).alias("null"))
    worst = worst.first()
    if worst.n is None or worst.n == 1 and not worst.null:
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    n = partitions(docs.sparkSession)
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    placed = written(
        rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        .withColumn("place", F.monotonically_increasing_id()), "order"
    )
    return placed.select(F.col("place").alias("doc"), "doc_id", "text")


def removed(docs: DataFrame) -> DataFrame:
    """numbered documents to spans to remove: doc, start, end (bytes), not merged."""
    spark = prepare(docs.sparkSession, 256)
    n = partitions(spark)
    texts = docs.select("doc", "text")
    parsed = texts.mapInArrow(_anchors, "anchor long, c long, d long, doc long, run long, copy boolean")
    # Copies need no company and are dealt by themselves, so that a common passage is no partition of its own.
    dealt = parsed.repartition(n, F.when(F.col("copy"), F.xxhash64("doc", "run")).otherwise(F.col("anchor")))
    folded = written(dealt.mapInArrow(_fold, "doc long, run long, anchor long, copy boolean, deep boolean"), "runs")
    start = F.shiftright("run", 8)
    copies = folded.filter("copy").select(
        "doc", start.alias("start"), (start + F.col("run").bitwiseAND(255) + SPAN).alias("end")
    )
    wanted = folded.filter("not copy").groupBy("doc").agg(F.collect_list(F.struct("run", "anchor", "deep")).alias("wanted"))
    contexts = texts.join(wanted, "doc").mapInArrow(_fetch, "anchor long, doc long, start long, context binary")
    dealt = contexts.repartition(n, "anchor").sortWithinPartitions("anchor")
    return copies.unionByName(dealt.mapInArrow(_merge, "doc long, start long, end long"))


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, what is left."""
    merged: list[list[int]] = []
    for a, z in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z])
    kept, at = [], 0
    for a, z in merged:
        kept.append(raw[at:a])
        at = z
    return sum(z - a for a, z in merged), len(merged), b"".join((*kept, raw[at:]))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every document."""
    docs = numbered(docs)
    spans = written(removed(docs), "spans").groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = docs.join(spans, "doc", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = utf8(text)
                row = len(raw), *cut(raw, [(x["start"], x["end"]) for x in found or ()])
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
