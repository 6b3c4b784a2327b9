"""Language-model scoring with a hashed maximum-entropy model.

Tokens are a text's words (A-Z lower-cased) and one end. The model predicts a token from the two before it:

    P(token | h) = (1 - u) * P(class | h) * P(token | class, h),   P(unknown) = u

* u is the base's own share for an unknown word, so that unlikely text can't gain by being unknown.
* Classes: the end; the HEAD most frequent training words, WIDE to a class, by rank; all other training
  words by a hash of their last three bytes.
* P(class | h) is a softmax over the classes, P(token | class, h) a softmax over a head class's words; both
  are log-linear in hashed features: the previous word, the one before it (skip), and the pair. In other
  classes words share by their counts.
* Training: in each of ROUNDS rounds every task walks over its part of the training documents in
  mini-batches with Adagrad steps on its copy of the weights; the tasks' updates are averaged row by row,
  weighted by how many tokens touched the row. All training documents are used, each in one round.

The weights have HASH rows, beyond TOKENS training tokens more: they grow with the fourth root of the tokens, and
the words with a context code of their own with them, up to MOST_ROWS (100 MB). They reach the driver; updates are averaged in two steps, so that no
group has a row from every task. Counts of all training words stay in a table, which grows with the corpus;
only the most frequent, at most FREQUENT (a fixed number), are sent to the tasks, and the rest of the
tokens are joined with the table. Words are counted by 64-bit hashes: the odds that any two of V different words
share one are at most V ** 2 / 2 ** 65 (3e-8 for a million words, 3 % for a thousand million), and two that do would
be counted as one.

Defined results: null and empty texts are one end; a null id counts as the empty string for the split;
repeated rows are learned and scored each; without training documents all tokens are unknown; extra
columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER, partitions, prepare, table, utf8, written

FREQUENT = 1 << 19
LEVELS = 16  # steps for each doubling of a count
WIDE = 32
HEAD = 31 * WIDE
TAILS = 32
CLASSES = 1 + HEAD // WIDE + TAILS
CONTEXT = 4000  # words with a context code of their own, for each HASH rows of weights
HASH = 1 << 14
#: Training tokens up to which there are HASH rows; beyond, rows grow with the fourth root of the tokens, in doublings.
TOKENS, MOST_ROWS = 100_000_000, 1 << 18
ROUNDS = 2
BATCH = 1 << 14
RATE = 0.2
ROWS = 64  # of weights in a message
TOGETHER = 128  # documents scored together
_MEMO: dict[str, "Codes"] = {}


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(LOWER).split()


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


def word_hash(word: bytes) -> int:
    return (xxh64_intdigest(word) ^ 1 << 63) - (1 << 63)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def training() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1


def count_words(docs: DataFrame) -> DataFrame:
    """w (a word's hash), tail, c: counts of all words of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(n: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(word_hashes(list(n))),
                    pa.array([tail_class(w) for w in n], pa.int8()),
                    pa.array(list(n.values()), pa.int64()),
                ],
                ["w", "tail", "n"],
            )

        n: Counter[bytes] = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                n.update(words_of(text))
            if len(n) > 500_000:
                yield flush(n)
                n.clear()
        yield flush(n)

    rows = docs.select("text").mapInArrow(count, "w long, tail byte, n long")
    return rows.groupBy("w").agg(F.first("tail").alias("tail"), F.sum("n").alias("c"))


def rows_for(tokens: int) -> int:
    """Rows of weights for a corpus of so many training tokens."""
    doublings = round(np.log2(max(tokens, TOKENS) / TOKENS) / 4)
    return min(HASH << doublings, MOST_ROWS)


class Vocabulary:
    """What tasks need of the training counts; ranks run by falling count, then hash."""

    def __init__(self, frequent: pa.Table, n: int, kinds: int, ends: int, masses: dict[int, int]):
        hashes, tails, found = (frequent.column(x).to_numpy() for x in ("w", "tail", "c"))
        self.key = uuid.uuid4().hex  # an id() could be met again in a worker that outlives this vocabulary
        order = np.lexsort((hashes, -found))
        hashes, self.tails, self.counts = hashes[order], tails[order].astype(np.int8), found[order]
        self.by_hash = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.by_hash]
        self.n, self.kinds, self.ends = n, kinds, ends
        self.rows = rows_for(n)
        self.context = CONTEXT * (self.rows // HASH)
        self.start = self.context + TAILS
        self.space = n + 0.5 * (kinds + 1)
        self.unknown = 0.5 / self.space
        mass = np.array([masses.get(k, 0) for k in range(TAILS)], np.float64)
        np.subtract.at(mass, self.tails[:HEAD], self.counts[:HEAD])
        self.mass = np.maximum(mass, 1.0)
        head = np.zeros(HEAD)
        head[: len(self.counts[:HEAD])] = self.counts[:HEAD]
        prior = np.concatenate([[ends], head.reshape(-1, WIDE).sum(axis=1), mass]) + 1e-3
        self.prior = np.log(prior / prior.sum()).astype(np.float32)
        inner = head.reshape(-1, WIDE) + 1e-3
        self.inner = np.log(inner / inner.sum(axis=1, keepdims=True)).astype(np.float32)


MISSING = -(1 << 30)


class Codes(dict):
    """Words to codes: the rank, or -1 - tail class for words beyond the frequent ones."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v = v

    def learn(self, words: list[bytes]) -> None:
        h = word_hashes(words)
        tails = np.fromiter(map(tail_class, words), np.int32, len(words))
        if len(self.v.hashes):
            i = np.minimum(np.searchsorted(self.v.hashes, h), len(self.v.hashes) - 1)
            found = np.where(self.v.hashes[i] == h, self.v.by_hash[i], -1 - tails)
        else:
            found = -1 - tails
        self.update(zip(words, found.tolist(), strict=True))

    def of(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """Codes of each document's words; those not met before are looked up together."""
        out = [np.fromiter(map(self.get, w, repeat(MISSING)), np.int32, len(w)) for w in docs]
        misses = [np.flatnonzero(x == MISSING) for x in out]
        missed = [[w[i] for i in at.tolist()] for w, at in zip(docs, misses, strict=True)]
        new = list(set().union(*missed))
        if new:
            if len(self) + len(new) > 600_000:
                self.clear()
            self.learn(new)
            for x, at, w in zip(out, misses, missed, strict=True):
                x[at] = list(map(self.__getitem__, w))
        return out


def codes(v: Vocabulary) -> Codes:
    if v.key not in _MEMO:
        _MEMO.clear()
        _MEMO[v.key] = Codes(v)
    return _MEMO[v.key]


END = 1 << 30


class Tokens:
    """A run of whole documents: codes with ends, classes, and hashed features."""

    def __init__(self, v: Vocabulary, docs: list[np.ndarray]):
        size = np.array([len(x) + 1 for x in docs])
        self.ends = np.cumsum(size) - 1
        self.code = np.full(int(size.sum()), END, np.int32)
        inside = np.ones(len(self.code), bool)
        inside[self.ends] = False
        self.code[inside] = np.concatenate(docs) if docs else []
        code = self.code
        tail = np.where(code < 0, -1 - code, 0)
        deep = (code >= v.context) & (code < END)
        tail[deep] = v.tails[code[deep]]
        far = (code >= HEAD) & (code < v.context)
        tail[far] = v.tails[code[far]]
        self.tail = tail
        context = np.where((code >= 0) & (code < v.context), code, v.context + tail).astype(np.int64)
        context[self.ends] = v.start
        one = np.concatenate([[v.start], context[:-1]])
        two = np.concatenate([[v.start], one[:-1]])
        starts = np.concatenate([[0], self.ends[:-1] + 1])
        two[starts] = v.start
        self.v = v
        self.head = (code >= 0) & (code < HEAD)
        self.group = np.where(self.head, 1 + code // WIDE, np.where(code == END, 0, 1 + HEAD // WIDE + tail))
        self.one, self.two = one, two

    def contexts(self, at: np.ndarray, group: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct contexts at these places: keys, where each is first, and which of them each place has."""
        key = (self.one[at] * (self.v.start + 1) + self.two[at]) * CLASSES + group
        return np.unique(key, return_index=True, return_inverse=True)

    def features(self, at: slice | np.ndarray, group: np.ndarray | int = 0) -> list[np.ndarray]:
        one, two = self.one[at], self.two[at]

        def row(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
            x = ((a * 8191 + b) * 64 + group) * 4 + kind
            x = (x * 0x9E3779B97F4A7C1) & 0x7FFFFFFFFFFFFFFF
            return (x >> 40) & (self.v.rows - 1)

        zero = np.zeros_like(one)
        return [row(one, zero, 0), row(two, zero, 1), row(one, two, 2)]


PIECE = 1 << 11  # rows whose class scores are in hand at a time, so that they stay in the processor's cache


def _exponents(w: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    x = np.take(w, rows[0], axis=0)
    x += np.take(w, rows[1], axis=0)
    x += np.take(w, rows[2], axis=0)
    x += bias
    return x


def softmax(w: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Log probabilities."""
    x = _exponents(w, rows, bias)
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


def log_shares(w: np.ndarray, t: "Tokens", at: np.ndarray, group: np.ndarray | int, bias: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log probabilities of y alone, for the tokens of t at these places; group: of all or of each; bias: one row for all,
    or one a group. Tokens with equal contexts share one sum over all outcomes."""
    _, first, own = t.contexts(at, group)
    each = lambda x, i: x[i] if isinstance(x, np.ndarray) else x
    rows = t.features(at[first], each(group, first))
    total = np.empty(len(first), np.float32)
    for a in range(0, len(first), PIECE):
        i = slice(a, a + PIECE)
        part = [r[i] for r in rows]
        x = _exponents(w, part, bias if bias.ndim == 1 else bias[each(group, first)[i] - 1])
        np.exp(x, out=x)
        total[i] = np.log(x.sum(axis=1))
        bad = np.flatnonzero(~np.isfinite(total[i]))
        if len(bad):
            x = _exponents(w, [r[bad] for r in part], bias if bias.ndim == 1 else bias[each(group, first)[i][bad] - 1])
            m = x.max(axis=1)
            total[i][bad] = m + np.log(np.exp(x - m[:, None]).sum(axis=1))
    hit = bias[y] if bias.ndim == 1 else bias[each(group, slice(None)) - 1, y]
    return hit + w[rows[0][own], y] + w[rows[1][own], y] + w[rows[2][own], y] - total[own]


def _shares(w: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Probabilities, piece by piece."""
    out = np.empty((len(rows[0]), w.shape[1]), np.float32)
    for a in range(0, len(out), PIECE):
        at = slice(a, a + PIECE)
        own = bias if bias.ndim == 1 else bias[at]
        x = _exponents(w, [r[at] for r in rows], own)
        np.exp(x, out=x)
        total = x.sum(axis=1, keepdims=True)
        x = x / total if np.isfinite(total).all() else np.exp(softmax(w, [r[at] for r in rows], own))
        out[at] = x
    return out


def segment_sums(x: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the runs of n rows from first on, by doubling, in x itself."""
    within = np.arange(len(x), dtype=np.int32) - np.repeat(first, n).astype(np.int32)
    left = np.repeat(n, n).astype(np.int32) - within  # rows of the run from this one on
    at, reach = np.arange(len(x)), 1
    while True:
        at = at[(within[at] & (2 * reach - 1) == 0) & (left[at] > reach)]
        if not len(at):
            return x[first]
        x[at] += x[at + reach]
        reach *= 2


def step(
    w: np.ndarray, squares: np.ndarray, touched: np.ndarray, rows: list[np.ndarray], bias: np.ndarray, own: np.ndarray, y: np.ndarray
) -> None:
    """An Adagrad step on a mini-batch, in place. rows and bias are of its distinct contexts; own: which of them each
    token has; y: its outcome."""
    p = _shares(w, rows, bias)
    times = np.bincount(own, minlength=len(p))
    p *= times[:, None].astype(np.float32)
    np.subtract.at(p, (own, y), np.float32(1))
    for r in rows:
        order = np.argsort(r.astype(np.uint16) if len(w) <= 1 << 16 else r, kind="stable")
        s = r[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        here = s[first]
        n = np.add.reduceat(times[order], first)
        g = segment_sums(np.take(p, order, axis=0), first, np.diff(np.append(first, len(s))))
        g /= np.sqrt(n)[:, None]
        squares[here] += (g * g).mean(axis=1)
        touched[here] += n
        w[here] -= (RATE / np.sqrt(squares[here] + 1e-4))[:, None] * g


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """doc_id, held_out, turn (the round that learns the document), codes (of its words, int32) and rare (hashes of the
    words beyond the frequent ones, in order, int64), written: texts are cut and looked up once for all that follows."""
    sent = docs.sparkSession.sparkContext.broadcast(v)
    turn = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(ROUNDS)).cast("int")
    rows = docs.select("doc_id", (~training()).alias("held_out"), turn.alias("turn"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = codes(sent.value)
        for b in batches:
            own = [words_of(t) for t in b.column("text").to_pylist()]
            found, rare = memo.of(own), []
            for code, words in zip(found, own, strict=True):
                rare.append(word_hashes([words[i] for i in np.flatnonzero(code < 0).tolist()]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), b.column("turn"), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(rare, pa.binary())],
                ["doc_id", "held_out", "turn", "codes", "rare"],
            )

    return written(rows.mapInArrow(run, "doc_id long, held_out boolean, turn int, codes binary, rare binary"), "codes")


def tokens_of(v: Vocabulary, batches: Iterator[pa.RecordBatch], least: int) -> Iterator[Tokens]:
    """Runs of whole documents with `least` tokens or more."""
    held, size = [], 0
    for b in batches:
        for raw in b.column("codes").to_pylist():
            held.append(np.frombuffer(raw, np.int32))
            size += len(held[-1]) + 1
            if size >= least:
                yield Tokens(v, held)
                held, size = [], 0
    if held:
        yield Tokens(v, held)


SUMS = "part long, n binary, change binary, raw boolean"


def train(coded: DataFrame, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Weights over classes and over the words of head classes, from encoded documents."""
    spark = coded.sparkSession
    sent = spark.sparkContext.broadcast(v)
    size = v.rows
    model = [np.zeros((size, CLASSES), np.float32), np.zeros((size, WIDE), np.float32)]
    for number in range(ROUNDS):
        base = spark.sparkContext.broadcast(model)

        def walk(batches: Iterator[pa.RecordBatch], base=base) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            v = sent.value
            w = [x.copy() for x in base.value]
            squares = [np.zeros(size, np.float32) for _ in w]
            touched = [np.zeros(size, np.float32) for _ in w]
            for t in tokens_of(v, batches, 8 * BATCH):
                for a in range(0, len(t.code), BATCH):
                    at = np.arange(a, min(a + BATCH, len(t.code)))
                    _, first, own = t.contexts(at)
                    step(w[0], squares[0], touched[0], t.features(at[first]), v.prior, own, t.group[at])
                    at = at[t.head[at]]
                    if len(at):
                        group = t.group[at]
                        _, first, own = t.contexts(at, group)
                        step(w[1], squares[1], touched[1], t.features(at[first], group[first]), v.inner[group[first] - 1], own, t.code[at] % WIDE)
            for k in range(2):
                for a in range(0, size, ROWS):
                    n = touched[k][a : a + ROWS]
                    if n.any():
                        change = w[k][a : a + ROWS] - base.value[k][a : a + ROWS]
                        yield pa.RecordBatch.from_pydict(
                            {"part": [k * size + a], "some": [TaskContext.get().partitionId() >> 7], "n": [n.astype(np.float64).tobytes()],
                             "change": [change.astype(np.float16).tobytes()], "raw": [True]}
                        )

        def total(key, parts):
            """Rows of tasks, or sums of such, to their sum: n, and changes weighted by n."""
            n, change = np.zeros(ROWS), 0.0
            for m, x, raw in zip(*(parts.column(c).to_pylist() for c in ("n", "change", "raw")), strict=True):
                m = np.frombuffer(m, np.float64)
                n += m
                x = np.frombuffer(x, np.float16).reshape(ROWS, -1) * m[:, None] if raw else np.frombuffer(x, np.float64).reshape(ROWS, -1)
                change = change + x
            return pa.Table.from_pydict({"part": [key[0].as_py()], "n": [n.tobytes()], "change": [change.tobytes()], "raw": [False]})

        here = coded.filter(~F.col("held_out") & (F.col("turn") == number)).select("codes")
        parts = here.mapInArrow(walk, "part long, some long, n binary, change binary, raw boolean")
        summed = parts.groupBy("part", "some").applyInArrow(total, SUMS).groupBy("part").applyInArrow(total, SUMS)
        model = [x.copy() for x in model]
        for x in summed.collect():
            k, a = divmod(x.part, size)
            n = np.maximum(np.frombuffer(x.n, np.float64), 1e-9)
            model[k][a : a + ROWS] += (np.frombuffer(x.change, np.float64).reshape(ROWS, -1) / n[:, None]).astype(np.float32)
    return model[0], model[1]


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most `most` rows of counts (w, c), those of the largest counts: all of the levels (LEVELS to a doubling) that
    fit, and of the level behind them the words with the smallest hashes, about as many as fit."""
    level = F.floor(F.log2(F.col("c").cast("double")) * LEVELS)
    found = {x.level: x.n for x in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    room, cut, edge, share = most, max(found, default=0) + 1, -1, 0.0
    for x in sorted(found, reverse=True):
        if found[x] > room:
            edge, share = x, 0.98 * room / found[x]
            break
        room -= found[x]
        cut = x
    spread = 1 << 40
    few = (level == edge) & (F.pmod("w", F.lit(spread)) < F.lit(int(share * spread)))
    return counts.filter((level >= cut) | few).limit(most)


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    masses = {x.tail: x.c for x in counts.groupBy("tail").agg(F.sum("c").alias("c")).collect()}
    frequent = most_frequent(counts, FREQUENT).select("w", "tail", "c").toArrow()
    return Vocabulary(frequent, (total.n or 0) + ends, total.v + (ends > 0), ends, masses)


OUT = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double,"
    " w long, n long, lm double"
)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    learned = rows.filter(training())
    counts = written(count_words(learned), "words")
    v = vocabulary(counts, learned.count())
    coded = encode(rows, v)
    weights = train(coded, v)
    sent, model = spark.sparkContext.broadcast(v), spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, (outer, inner) = sent.value, model.value
        row = TaskContext.get().partitionId() << 33
        known = np.log10((v.counts + 0.5) / v.space)
        share = np.log10(np.maximum(v.counts, 1) / v.mass[v.tails]) if len(v.counts) else known
        # Tokens beyond the frequent ones may be unknown: their parts are settled after the join.
        base_end = np.log10((v.ends + 0.5) / v.space)
        rest = np.log10(1 - v.unknown) if v.unknown < 1 else 0.0
        log = np.log10(np.e)
        for b in batches:
            found, far = b.column("codes").to_pylist(), b.column("rare").to_pylist()
            for a in range(0, len(found), TOGETHER):
                own = [np.frombuffer(x, np.int32) for x in found[a : a + TOGETHER]]
                t = Tokens(v, own)
                n = len(t.code)
                lm = log_shares(outer, t, np.arange(n), 0, v.prior, t.group) * np.float64(log)
                head = np.flatnonzero(t.head)
                if len(head):
                    lm[head] += log_shares(inner, t, head, t.group[head], v.inner, t.code[head] % WIDE) * np.float64(log)
                lm += rest
                end, rare = t.code == END, t.code < 0
                tail = ~(end | rare | t.head)
                lm[tail] += share[t.code[tail]]
                lm[rare] -= np.log10(v.mass[t.tail[rare]])
                base = np.zeros(n)
                sure = ~(end | rare)
                base[sure] = known[t.code[sure]]
                base[end] = base_end
                if not v.ends:
                    lm[end] = np.log10(v.unknown)
                starts = np.concatenate([[0], t.ends[:-1] + 1])
                totals = (
                    np.add.reduceat(base, starts), np.add.reduceat(np.where(rare, 0, lm), starts),
                    np.add.reduceat((sure | end & (v.ends > 0)).astype(np.int64), starts), np.diff(np.append(starts, n)),
                )
                ids, held = b.column("doc_id")[a : a + TOGETHER], b.column("held_out")[a : a + TOGETHER]
                size = len(own)
                rows = np.arange(row, row + size)
                none = lambda kind, k=size: pa.nulls(k, kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), ids, held, pa.array(totals[3]), pa.array(totals[2]), pa.array(totals[0]), pa.array(totals[1]),
                     none(pa.int64()), none(pa.int64()), none(pa.float64())], NAMES,
                )
                where = np.flatnonzero(rare)
                if len(where):
                    doc = np.searchsorted(t.ends, where)
                    hashes = np.frombuffer(b"".join(far[a : a + TOGETHER]), np.int64)
                    order = np.lexsort((hashes, doc))
                    doc, hashes, part = doc[order], hashes[order], lm[where][order]
                    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])]))
                    k = len(first)
                    empty = lambda kind, k=k: pa.nulls(k, kind)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[doc[first]]), empty(pa.int64()), empty(pa.bool_()), empty(pa.int64()), empty(pa.int64()),
                         empty(pa.float64()), empty(pa.float64()), pa.array(hashes[first]),
                         pa.array(np.diff(np.append(first, len(doc)))), pa.array(np.add.reduceat(part, first))], NAMES,
                    )
                row += size

    scored = written(coded.mapInArrow(score, OUT), "scores")
    rare = scored.filter("w IS NOT NULL").select("row", "w", "n", "lm")
    found = rare.join(counts.select("w", "c"), "w", "left")
    count = F.coalesce("c", F.lit(0))
    found = found.groupBy("row").agg(
        F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10((count + 0.5) / F.lit(v.space))).alias("rare_base"),
        F.sum(
            F.when(count > 0, F.col("lm") + F.col("n") * F.log10(F.greatest(count, F.lit(1))))
            .otherwise(F.col("n") * F.lit(float(np.log10(v.unknown))))
        ).alias("rare_lm"),
    )
    out = scored.filter("w IS NULL").drop("w", "n", "lm").join(found, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return out.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "rare_known"), F.lit(v.n).cast("bigint").alias("train_tokens"),
        plus("base_score", "rare_base"), plus("score", "rare_lm"),
    )


NAMES = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "w", "n", "lm"]


def op3_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
