"""Each operator against a brute-force version, on texts with nulls, empty and long ones, ties and repeats."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from registra.llm import (
    bwt_dedup,
    fm_decontamination,
    license_join,
    maxent_lm,
    preference_format,
    quality_rules,
    simhash_pivots,
    source_mixing,
    token_output,
    warc,
)
from registra.llm.common import scratch, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts(seed=1):
    """Odd texts: null, empty, one word, equal, near-equal, shared passages, a long one, other white space."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "Été", "größer", "ñandú", "x%%%", "a|b", "end.", "Stop!!", "日本", "naïve", *(f"w{k}" for k in range(60))]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = line(60)
    base = [line(80) + ".\n" + line(30) + "." for _ in range(12)]
    out = [None, "", " ", "one", "Two words", base[0], base[0], base[0].replace("the", "teh", 1)]
    out += base[1:] + [base[3] + "\n" + passage, passage + " " + base[4], passage, passage * 3]
    out += ["tab\there  twice\n\n\nlines \x0b odd\x85space end<|endoftext|>x", " lead", "trail ", line(4000), "\n".join(["Same line here."] * 9)]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(k * 3, t, "en", None if k % 7 == 0 else f"s{k % 4}", len(t or ""), -1, "clash") for k, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {x.doc_id: x for x in df.collect()}


def test_quality_rules(spark, docs, rows, none):
    got = by_id(quality_rules.judge(docs))
    for k, t, *_ in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        x = got[k]
        assert (x.n_words, x.word_chars, x.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
        assert x.n_symbols == len(re.findall(r"[#*$%&|<>]", t or "")) and x.n_dup_lines == len(lines) - len(set(lines))
        assert x.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (x.base_failed and x.kept) and x.lang == "en"
    assert quality_rules.judge(none).count() == 0 and quality_rules.clean(docs).columns == docs.columns


def test_quality_line_rules(spark):
    good = "These are plain words of a text that ends well."
    bad = ["Home | News | Sport | Contact", "a### b*** c%%% d&&&", "BUY!! NOW!! YES!! OH!! MY!!", "Click here to read more of it.", "Sign up"]
    text = "\n".join([good] * 9 + bad)
    x = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert x.clean_text == "\n".join([good] * 9)
    bad = ["Alle Rechte vorbehalten, und hier steht noch mehr.", "Pour plus de détails cliquez ici, s'il vous plaît.", "Para leer más haga clic en el enlace.", "Start › Shop › Buch", "Rot • Blau • Gelb"]
    kept = ["Er sagte: „Nun gut!“", "Ende.»  ", "(Voilà.)", "Short end?']", "a word · another word and some words more follow here"]
    text = "\n".join([good] * 9 + bad + kept)
    rows = spark.createDataFrame([(1, text), (None, text), (1, text), (2, "")], "doc_id long, text string")
    got = quality_rules.judge(rows).collect()
    assert len(got) == 4 and [x.clean_text for x in got if x.n_words] == ["\n".join([good] * 9 + kept[1:])] * 3
    assert all(x.n_kept_words == len(words(x.clean_text)) for x in got)


@pytest.mark.parametrize("segment", [1 << 21, 50])
def test_token_output(spark, docs, rows, none, segment):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    path = scratch(spark, "t")
    listed = token_output.write_tokens(docs, path, tokenizer_path(), files=3, segment=segment)
    got, start = by_id(token_output.read_tokens(spark, path, listed)), 0
    for k, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids
        assert (got[k].start, got[k].n_tokens) == (start, len(ids))
        start += len(ids)
    assert token_output.digest(none, tokenizer_path()).count() == 0
    odd = spark.createDataFrame([(None, "b"), (5, "x"), (5, "x"), (5, None)], "doc_id long, text string")
    assert [x.doc_id for x in token_output.digest(odd, tokenizer_path()).orderBy("start").collect()] == [None, 5, 5, 5]


def test_token_coding():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        ids = rng.choice(np.array([0, 1, 300, 70_000]), n) if n < 1000 else rng.integers(0, 70_000, n)
        raw = token_output.to_bytes([None], np.array([n]), ids.astype("<u4"))
        for keys, counts, back in token_output.segments(io.BytesIO(2 * raw)):
            assert keys == [None] and counts.tolist() == [n] and back.tolist() == ids.tolist()


def test_token_pieces(monkeypatch):
    """Ids equal the library's for every kind of piece, also when the memo is thinned again and again."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "_MEMO_ENTRIES", 40)
    rng = random.Random(6)
    parts = ["don't", "we'll", "'s", "it's'", "x_y", "__", "12", "3.5", "a1b2", "Été", "größer,", "ſ", "日本", "½", "word###", "end.", '"q"', "(x)", "e\u0301", "ʼn", "µ", "#", "...", "'", "İ!"]
    texts = ["", *(rng.choice(" \n").join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(400)), "two  blanks", " lead", "a<|endoftext|>b"]
    texts += ["\n".join(rng.choices(parts, k=30)) + " " + "".join(rng.choices(parts, k=40)) for _ in range(50)]
    tokenizer, encoder = Tokenizer.from_file(tokenizer_path()), token_output.Encoder(tokenizer_path())
    assert encoder.cuts
    encoder.memo.clear()
    for a in range(0, len(texts), 7):
        for t, ids in zip(texts[a : a + 7], encoder.encode(texts[a : a + 7]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_token_vocabulary_of_another_kind(tmp_path):
    """Vocabularies that put a blank in front are encoded whole."""
    import json
    from pathlib import Path

    from tokenizers import Tokenizer

    told = json.loads(Path(tokenizer_path()).read_text())
    told["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(told))
    encoder, tokenizer = token_output.Encoder(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    assert not encoder.cuts
    assert np.frombuffer(encoder.encode(["a b\nc"])[0], "<u4").tolist() == tokenizer.encode("a b\nc", add_special_tokens=False).ids


def test_simhash(spark, docs, rows, none):
    from xxhash import xxh64_intdigest

    def reference(t):
        w = words(low(t))
        if not w:
            return 0
        s = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
        h = [xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {k: reference(t) for k, t, *_ in rows}
    root = {k: k for k in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    got = by_id(simhash_pivots.near_duplicates(docs))
    assert {k: (f"{fp[k]:016x}", root[k]) for k in fp} == {k: (x.fingerprint, x.component_id) for k, x in got.items()}
    kept = [x.doc_id for x in simhash_pivots.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(root.values()))
    assert simhash_pivots.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "a b"), (4, "a b")], "doc_id long, text string")
    assert simhash_pivots.keep_one(odd).count() == 1


@pytest.mark.parametrize("cell", [4096, 64])
def test_simhash_links(spark, monkeypatch, cell):
    """Chains and large cells: components of random near fingerprints as by brute force."""
    monkeypatch.setattr(simhash_pivots, "CELL", cell)
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2**64, 60, dtype=np.uint64)]
    for _ in range(500):
        x = fps[rng.integers(len(fps))]
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            x ^= 1 << int(b)
        fps.append(x)
    u = np.array(sorted(set(fps)), np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    label = np.arange(len(u))
    while not (label == (new := np.array([label[n].min() for n in near]))).all():
        label = new
    prints = spark.createDataFrame([(int(k), int(x)) for k, x in enumerate(u.view(np.int64))], "doc_id long, fp long")
    figures = simhash_pivots.pivot_figures(simhash_pivots.tabled(prints))
    assert figures["pairs"] > figures["discarded"] > 0 and figures["linked"] > 0
    got = {x.fp: x.component_id for x in simhash_pivots.groups(prints).collect()}
    assert [got[int(x)] for x in u.view(np.int64)] == label.tolist()


def test_decontamination(spark, docs, rows, none):
    items = [(1, " ".join(words(texts()[5])[10:40])), (2, "w1 W2"), (3, None), (10, texts()[20]), (None, "the of"), (4, "zzz never there")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = by_id(fm_decontamination.decontaminate(docs, bench))
    for k, t, *_ in rows:
        w, hit, named = pattern.findall(low(t)), set(), set()
        for item, x in items:
            v = pattern.findall(low(x))
            if item is None or not v:
                continue
            for i in range(max(1, len(v) - 12)):
                p = v[i : i + 13]
                for j in range(len(w) - len(p) + 1):
                    if w[j : j + len(p)] == p:
                        hit.update(range(j, j + len(p)))
                        named.add(str(item))
        x = got[k]
        assert (x.n_words, x.n_hit, x.n_items) == (len(w), len(hit), len(named))
        assert x.items_sha256 == hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        assert x.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
        assert sum(s.end - s.start for s in x.spans) == len(hit)
    assert fm_decontamination.decontaminate(none, bench).count() == 0
    assert not any(x.contaminated for x in fm_decontamination.decontaminate(docs, bench.limit(0)).collect())
    assert fm_decontamination.drop_contaminated(docs, bench).columns == docs.columns


def test_decontamination_in_blocks(spark, docs, rows, monkeypatch):
    """A benchmark of many blocks gives what one block gives."""
    items = [(k, " ".join(words(t)[k : k + 20])) for k, t in enumerate(texts()) if t]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = by_id(fm_decontamination.decontaminate(docs, bench))
    monkeypatch.setattr(fm_decontamination, "BLOCK", 60)
    assert len(list(fm_decontamination.query_blocks(bench, 13))) > 3
    many = by_id(fm_decontamination.decontaminate(docs, bench))
    assert one == many and any(x.n_hit for x in one.values())
    twice = fm_decontamination.decontaminate(docs.union(docs), bench).collect()
    assert len(twice) == 2 * len(rows) and all(x == one[x.doc_id] for x in twice)


def test_fm_index():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 400)
    index = fm_decontamination.FMIndex(text.astype(np.int32), 4)
    for n in (1, 2, 5):
        for at in range(0, 380, 17):
            p = text[at : at + n]
            if (p == 0).any():
                continue
            a, b = index.search(p[None, :].astype(np.int32), np.array([n]))
            places = sorted(index.locate(np.arange(a[0], b[0])).tolist())
            assert places == [i for i in range(401 - n) if (text[i : i + n] == p).all()]


@pytest.mark.parametrize(("shard", "group"), [(262_144, 1024), (100, 3), (40, 2)])
def test_mixing(spark, docs, rows, none, monkeypatch, shard, group):
    monkeypatch.setattr(source_mixing, "SHARD_WORDS", shard)
    monkeypatch.setattr(source_mixing, "GROUPS", group)
    sizes = source_mixing.sized(docs).cache()
    out = source_mixing.plan(sizes, sizes).withColumn("taken", source_mixing.taken()).collect()
    assert len(out) == len(rows)
    size = {k: len(words(t)) for k, t, *_ in rows}
    total, by_source = sum(size.values()), {}
    for k, _, _, s, *_ in rows:
        by_source.setdefault(s, []).append(k)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, left, free = {}, total, set(order)
    while free:  # the contract's rule, step by step
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sum(size[k] for k in by_source[s])]
        for s in over or free:
            target[s] = min(share[s], 3 * sum(size[k] for k in by_source[s]))
        if not over:
            break
        left -= sum(target[s] for s in over)
        free -= set(over)
    taken = Counter()
    for x in out:
        assert x["size"] == size[x.doc_id] and 0 <= x.taken <= 3 * x["size"]
        assert math.isclose(x.target, target[x.source], rel_tol=1e-9)
        taken[x.source] += x.taken
    assert all(abs(taken[s] - target[s]) <= 8 for s in order)
    again = source_mixing.plan(sizes.repartition(5), sizes).withColumn("taken", source_mixing.taken())
    assert {(x.doc_id, x.taken) for x in again.collect()} == {(x.doc_id, x.taken) for x in out}
    mixed = Counter()
    for x in source_mixing.mix(docs).collect():
        mixed[x.doc_id] += len(words(x.text))
    assert +mixed == +Counter({x.doc_id: x.taken for x in out})
    assert source_mixing.plan(source_mixing.sized(none), source_mixing.sized(none)).count() == 0


def test_mixing_of_odd_tables(spark, monkeypatch):
    """Null ids, repeated rows, sources without words; too many sources are refused."""
    rows = [(None, "a b c", "x"), (None, "a b c", "x"), (1, "a b", None), (1, "a b", None), (2, None, "y"), (3, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = source_mixing.sized(df)
    out = source_mixing.plan(sizes, sizes).withColumn("taken", source_mixing.taken()).collect()
    assert len(out) == 6 and sum(x["size"] for x in out) == 10 and all(0 <= x.taken <= 3 * x["size"] for x in out)
    assert {x.source: x.source_size for x in out} == {"x": 6, None: 4, "y": 0, "z": 0}
    monkeypatch.setattr(source_mixing, "SOURCES", 3)
    with pytest.raises(ValueError, match="sources"):
        source_mixing.plan(sizes, sizes)


def test_sainte_lague():
    rng = random.Random(4)
    for _ in range(200):
        votes, seats = [rng.randrange(50) for _ in range(rng.randrange(1, 7))], rng.randrange(40)
        want = [0] * len(votes)
        for _ in range(seats):
            i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[i] += votes[i] > 0
        assert source_mixing.sainte_lague(votes, seats) == want


def test_bwt_dedup(spark, docs, rows, none):
    got, seen = by_id(bwt_dedup.dedup(docs)), set()
    for k, t, *_ in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        kept = bytes(c for c, z in zip(raw, gone, strict=True) if not z)
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, bytes(got[k].kept)) == (len(raw), sum(gone), runs, kept)
    assert bwt_dedup.dedup(none).count() == 0
    odd = spark.createDataFrame([(None, "q" * 150), (1, "q" * 150), (1, "q" * 150), (2, None)], "doc_id long, text string")
    assert sorted(x.n_removed for x in bwt_dedup.dedup(odd).collect()) == [0, 149, 150, 150]
    assert {x.n_bytes for x in bwt_dedup.dedup(odd).collect()} == {150, 0}


def test_bwt_chunks(spark, monkeypatch):
    """Texts longer than a chunk, and many small buckets."""
    monkeypatch.setattr(bwt_dedup, "CHUNK", 500)
    rng = random.Random(9)
    part = "".join(rng.choice("ab c") for _ in range(3000))
    other = "".join(rng.choice("abcdef ") for _ in range(5000))
    data = [(1, part + other), (2, other[500:3000] + "!" + part[100:900]), (3, part[:150] + other[-300:])]
    got, seen = by_id(bwt_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string"))), set()
    for k, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(t[i : i + 100])
        assert got[k].n_removed == sum(gone)


def removed_bytes(data):
    """Brute force: by document, which bytes go."""
    seen, out = set(), {}
    for k, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(t[i : i + 100])
        out[k] = gone
    return out


@pytest.mark.parametrize(("deep", "common", "roots"), [(1_000, 8, bwt_dedup.ROOTS), (1, 2, bwt_dedup.ROOTS), (3, 2, (1, 3, bwt_dedup.ROOTS[1]))])
def test_bwt_hot_passages(monkeypatch, deep, common, roots):
    """One passage in all documents with very many different contexts, many copies, texts of a few letters: the steps by
    themselves, in small chunks and buckets; multipliers under which blocks collide are given up."""
    for name, x in {"DEEP": deep, "COMMON": common, "CHUNK": 700, "BUCKET": 4000}.items():
        monkeypatch.setattr(bwt_dedup, name, x)
    monkeypatch.setattr(bwt_dedup, "ROOTS", roots) if roots[0] == 1 else None
    rng = random.Random(len(roots))
    some = lambda n, letters="abcdefgh ": "".join(rng.choice(letters) for _ in range(n))
    passage, page = some(60), some(400)
    data = [(k, some(90) + passage + some(90) if k % 3 else page) for k in range(60)] + [(k, some(130, "ab") + passage + some(10) + page[100:300]) for k in range(60, 75)]
    data += [(75, "ab" * 200), (76, "ba" * 150)]
    order = rng.sample(data, len(data))
    batches = lambda rows: pa.RecordBatch.from_pydict({"doc": [k for k, _ in rows], "text": [t for _, t in rows]})
    parsed = [b for at in (0, 30, 60) for b in bwt_dedup._anchors(iter([batches(order[at : at + 30])]))]
    entries = pa.Table.from_batches(list(bwt_dedup._fold(iter(parsed)))).to_pylist()
    gone = {k: bytearray(len(t)) for k, t in data}
    wanted = {}
    for x in entries:
        a, z = x["run"] >> 8, (x["run"] >> 8) + (x["run"] & 255) + 100
        if x["copy"]:
            gone[x["doc"]][a:z] = b"\1" * (z - a)
        else:
            wanted.setdefault(x["doc"], []).append(x)
    rows = [{"doc": k, "text": dict(data)[k], "wanted": w} for k, w in wanted.items()]
    kind = pa.schema([("doc", pa.int64()), ("text", pa.string()), ("wanted", pa.list_(pa.struct([("run", pa.int64()), ("anchor", pa.int64()), ("deep", pa.bool_())])))])
    fetched = pa.Table.from_batches(list(bwt_dedup._fetch(iter([pa.RecordBatch.from_pylist(rows, kind)])))).sort_by("anchor")
    for b in bwt_dedup._merge(iter(fetched.to_batches())):
        for x in b.to_pylist():
            gone[x["doc"]][x["start"] : x["end"]] = b"\1" * (x["end"] - x["start"])
    assert gone == removed_bytes(data)
    assert any(x["deep"] for x in entries) == (deep < 1_000)


def test_license(spark, docs, none):
    lines = ["Released under the MIT License.", "cc BY and CC-by", "Licensed under the Apache License, Version 2.0", "Licensed under CC BY-NC 4.0", "mit licenses"]
    got = by_id(license_join.scan(spark.createDataFrame([(k, x) for k, x in enumerate(lines)] + [(9, None)], "doc_id long, text string")))
    assert [got[k].labels for k in range(5)] == ["mit", "cc-by", "apache,apache-2.0", "cc-by,cc-by-nc", ""]
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (2, 0, 3) and got[9].n_words == 0
    assert license_join.scan(none).count() == 0 and license_join.scan(docs).count() == docs.count()


def test_license_of_odd_tables(spark):
    """Null ids, repeated rows, very long texts."""
    rows = [(None, "MIT License"), (None, "MIT License"), (3, "w " * 200_000 + "Released under the MIT License"), (4, "\n" * 500)]
    got = license_join.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(x.doc_id), x.n_words, x.labels) for x in got) == [("3", 200_005, "mit"), ("4", 0, ""), ("None", 2, "mit"), ("None", 2, "mit")]


def test_license_blocks(spark):
    """Notices that wrap over lines are found, words scattered over a long line are none, near notices stay apart."""
    bsd = "Redistribution and use in source and binary\nforms, with or without modification, are permitted provided\nthat the following conditions are met:"
    texts = [
        "x\nThis work is licensed under the GNU General Public\nLicense, version 3", bsd, "Released\n\nunder the MIT\nLicense",
        "released " + "a " * 90 + "under " + "b " * 90 + "the mit " + "c " * 90 + "license",
        "Released under the MIT License and once more Released under the MIT License\nReleased under the\nMIT License",
        "Released under the very own MIT License", bsd.replace("binary\n", "binary\n" + "z " * 9),
    ]
    got = by_id(license_join.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[k].labels for k in range(7)] == ["gpl,gpl-3.0", "bsd", "mit", "", "mit", "mit", ""]
    assert [got[k].score for k in (1, 3)] == [1, 0]
    assert [[(b.block, b.containment) for b in got[k].blocks] for k in (0, 2, 4, 5)] == [[(1, 1)], [(0, 1)], [(0, 1), (0, 1), (1, 1)], []]


def test_license_blocks_lose_nothing():
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(12)]
    templates = [(str(k), " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9)))) for k in range(12)]
    for threshold in (0.5, 0.8, 1.0):
        index = license_join.Index(templates, {w.encode(): rng.randrange(9) for w in vocabulary}, threshold)
        for _ in range(200):
            text = [w.encode() for w in rng.choices([*vocabulary, "zz", "zz"], k=rng.randrange(0, 40))]
            want = {}
            for k, (_, t) in enumerate(templates):
                s, n = set(t.encode().split()), math.ceil(len(t.split()) / threshold - 1e-9)
                best = max((len(s & set(text[a : a + n])) for a in range(len(text))), default=0)
                if best >= license_join.need(len(s), threshold):
                    want[k] = best / len(s)
            got = {}
            for _, k, share in index.blocks(text):
                got[k] = max(got.get(k, 0), share)
            assert got == want


def test_license_filters_lose_nothing():
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(25)]
    templates = [(str(k), " ".join(rng.sample(vocabulary, rng.randrange(1, 12)))) for k in range(15)]
    for threshold in (0.5, 0.8, 1.0):
        index = license_join.Index(templates, {w.encode(): rng.randrange(9) for w in vocabulary}, threshold)
        for _ in range(300):
            block = [w.encode() for w in rng.choices([*vocabulary, "zz"], k=rng.randrange(0, 20))]
            want = []
            for k, (_, t) in enumerate(templates):
                s = set(t.encode().split())
                if len(s & set(block)) >= license_join.need(len(s), threshold):
                    want.append((k, len(s & set(block)) / len(s)))
            assert index.matches(block) == want


def test_language_model(spark, docs, rows, none):
    got = by_id(maxent_lm.score_documents(docs))
    split = lambda t: (t or "").encode().translate(maxent_lm.LOWER).split()
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, *_ in rows}
    count = Counter(x for k, t, *_ in rows if not held[k] for x in [*split(t), "end"])
    n, v = sum(count.values()), len(count)
    for k, t, *_ in rows:
        tokens = [*split(t), "end"]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)
        x = got[k]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[k], len(tokens), sum(count[y] > 0 for y in tokens), n)
        assert math.isclose(x.base_score, base, rel_tol=1e-9) and math.isfinite(x.score) and x.score < 0
    assert sum(x.score for x in got.values()) > sum(x.base_score for x in got.values())
    assert maxent_lm.score_documents(none).count() == 0


def test_language_model_of_odd_tables(spark):
    """Null ids, repeated rows, no training documents, clashing columns."""
    rows = [(None, "a b", 1), (None, "a b", 2), (3, "a a", 3), (3, "a a", 3), (5, None, 4), (8, "", 5)]
    got = maxent_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string, score long")).collect()
    assert len(got) == 6 and len({x.train_tokens for x in got}) == 1
    alike = {}
    for x in got:
        alike.setdefault((x.doc_id, x.n_tokens), set()).add((x.base_score, x.score, x.n_known))
    assert all(len(x) == 1 for x in alike.values())
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 5 == 1)
    x = maxent_lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (True, 3, 0, 0) and math.isfinite(x.score)


def test_language_model_score(spark, docs, rows):
    """Scores against a walk over the tokens, one by one, with the same weights."""
    learned = docs.filter(maxent_lm.training())
    counts = maxent_lm.count_words(learned).cache()
    v = maxent_lm.vocabulary(counts, learned.count())
    count = {x.w: x.c for x in counts.collect()}
    outer, inner = maxent_lm.train(maxent_lm.encode(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), v), v)
    order = sorted(count, key=lambda w: (-count[w], w))
    rank = {w: k for k, w in enumerate(order)}
    m, start = maxent_lm, v.start
    got = by_id(m.score_documents(docs))

    def rows_of(one, two, group):
        out = []
        for a, b, kind in ((one, 0, 0), (two, 0, 1), (one, two, 2)):
            x = (((a * 8191 + b) * 64 + group) * 4 + kind) * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF
            out.append(x >> 40 & v.rows - 1)
        return out

    def share(w, bias, one, two, group, y):
        x = bias.astype(float) + sum(w[r].astype(float) for r in rows_of(one, two, group))
        return x[y] - math.log(np.exp(x).sum())

    for k, t, *_ in rows:
        want, one, two = 0.0, start, start
        for word in [*(t or "").encode().translate(m.LOWER).split(), None]:
            h = m.word_hash(word) if word is not None else None
            at, tail = rank.get(h), m.tail_class(word) if word is not None else 0
            if word is not None and at is None:
                want += math.log(v.unknown)
            else:
                want += math.log(1 - v.unknown)
                head = at is not None and at < m.HEAD
                group = 0 if word is None else 1 + at // m.WIDE if head else 1 + m.HEAD // m.WIDE + tail
                want += share(outer, v.prior, one, two, 0, group)
                if head:
                    want += share(inner, v.inner[group - 1], one, two, group, at % m.WIDE)
                elif word is not None:
                    want += math.log(count[h] / v.mass[tail])
            code = start if word is None else at if at is not None and at < v.context else v.context + tail
            one, two = code, one
        assert math.isclose(got[k].score, want / math.log(10), rel_tol=1e-4, abs_tol=1e-3)


def test_rows_grow():
    rows = [maxent_lm.rows_for(n) for n in (0, 10**8, 6 * 10**9, 10**11, 10**14, 10**20)]
    assert rows == [1 << 14, 1 << 14, 1 << 15, 1 << 16, 1 << 18, 1 << 18]


def test_larger_model(spark, docs, monkeypatch):
    """Rows beyond 16 bits train and score alike."""
    learned = docs.filter(maxent_lm.training())
    v = maxent_lm.vocabulary(maxent_lm.count_words(learned).cache(), learned.count())
    memo = maxent_lm.Codes(v)
    code = memo.of([maxent_lm.words_of(t) for t in texts() if t])
    out = []
    for rows in (1 << 14, 1 << 17):
        v.rows = rows
        t = maxent_lm.Tokens(v, code)
        w, squares, touched = np.zeros((rows, maxent_lm.CLASSES), np.float32), np.zeros(rows, np.float32), np.zeros(rows, np.float32)
        at = np.arange(len(t.code))
        for _ in range(3):
            _, first, own = t.contexts(at)
            maxent_lm.step(w, squares, touched, t.features(at[first]), v.prior, own, t.group[at])
        out.append(maxent_lm.log_shares(w, t, at, 0, v.prior, t.group).mean())
        assert touched.sum() == 9 * len(at)
    assert abs(out[0] - out[1]) < 0.5 and min(out) > v.prior[t.group].mean()


def test_most_frequent_is_bounded(spark):
    """However many words have the top count, or one count."""
    for count in ("1", "5000", "id % 7 + 1", "id + 1"):
        df = spark.range(3000).select(F.xxhash64("id").alias("w"), F.expr(count).cast("long").alias("c"))
        for most in (50, 700, 5000):
            got = maxent_lm.most_frequent(df, most).collect()
            assert min(most, 3000) * 0.8 <= len(got) <= most
            if count == "id + 1":
                assert min(x.c for x in got) > 3000 - 1.2 * most - 60


def test_language_model_sums_to_one(spark, docs):
    """Over all known words and the unknown one, after any context, probabilities come to 1."""
    vocabulary = maxent_lm.Vocabulary
    learned = docs.filter(maxent_lm.training())
    counts = maxent_lm.count_words(learned).cache()
    v = maxent_lm.vocabulary(counts, learned.count())
    assert isinstance(v, vocabulary)
    w = maxent_lm.train(maxent_lm.encode(docs.select("doc_id", "text"), v), v)
    t = maxent_lm.Tokens(v, [np.array([3, 1], np.int32)])
    outer = np.exp(maxent_lm.softmax(w[0], t.features(slice(2, 3)), v.prior))[0]
    total = outer[0]
    tails = np.zeros(maxent_lm.TAILS)
    rare = {x.tail: x.c for x in counts.groupBy("tail").sum("c").toDF("tail", "c").collect()}
    for k in range(maxent_lm.HEAD // maxent_lm.WIDE):
        inner = np.exp(maxent_lm.softmax(w[1], t.features(np.array([2]), np.array([k + 1])), v.inner[[k]]))[0]
        total += outer[1 + k] * inner.sum()
    for k, c in rare.items():
        mine = v.counts[: maxent_lm.HEAD][v.tails[: maxent_lm.HEAD] == k].sum()
        tails[k] = (c - mine) / v.mass[k]
    total += (outer[1 + maxent_lm.HEAD // maxent_lm.WIDE :] * tails).sum()
    assert (1 - v.unknown) * total + v.unknown <= 1 + 1e-5


TURNS = "conv_id long, turn long, role string, text string"


def test_preference(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 2, "user", "c"),
             (2, 0, "user", None), (3, 0, "user", None), (3, 0, "user", None), (None, 0, "user", "lost"), (4, None, None, "alone")]
    turns = spark.createDataFrame(turns, TURNS)
    got = {x.pair_id: x for x in preference_format.format_pairs(turns).collect()}
    assert (got[0].prompt, got[0].chosen, got[0].rejected) == ("<|user|>\nhi<|end|>\n", "<|assistant|>\na<|end|>\n", "<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n")
    assert [[tuple(y) for y in got[0][c]] for c in ("chosen_train", "rejected_train")] == [[(0, 23)], [(0, 23)]]
    assert (got[1].prompt, got[1].chosen, got[1].rejected, got[1].paired) == ("<|user|>\n<|end|>\n", "", "<|user|>\n<|end|>\n", True)
    assert (got[2].chosen, got[2].paired, got[2].chosen_train) == ("<|unknown|>\nalone<|end|>\n", False, [])
    pairs = spark.createDataFrame([(7, 1, 0)], "pair_id long, chosen_id long, rejected_id long")
    own = preference_format.format_preferences(turns, pairs)
    assert {x.segment for x in own.filter("part = 'chosen'").collect()} == {"<|assistant|>\nb<|end|>\n", "<|user|>\nc<|end|>\n"}


def test_preference_by_brute_force(spark):
    """Random conversations with repeats, ties, nulls, long and empty texts, large and negative ids, clashing columns."""
    rng = random.Random(12)
    ids = [*range(12), 2**62, 2**62 + 1, 2**62 + 2, 2**62 + 5, -1, -2, -7]
    words = ["a", "b", "", None, "é" * 5000, "a"]
    rows = []
    for c in ids:
        shared = rng.randrange(6)
        for t in range(rng.randrange(1, 9)):
            text = "same" if t < shared else rng.choice(words)
            rows += [(c, rng.choice([t, t, None]) if t > 4 else t, rng.choice(["user", "assistant", None]) if t > 2 else "user", text)] * rng.choice([1, 1, 1, 2, 3])
    rows += [(6, 0, "user", "again")] * 9000 + [(7, 0, "user", "again")] * 5000
    hashed = lambda x: (x is not None, hashlib.md5((x or "").encode()).hexdigest() if x is not None else "")
    order = lambda r: ((r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or ""), hashed(r[3]))
    talks = {}
    for r in rows:
        talks.setdefault(r[0], []).append(r)
    shown = lambda r: f"<|{r[2] or 'unknown'}|>\n{r[3] or ''}<|end|>\n"
    want = {}
    for pair in {c >> 1 for c in talks}:
        a, b = (sorted(talks.get(2 * pair + k, []), key=order) for k in (0, 1))
        n = 0
        while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
            n += 1
        parts = {"prompt": a[:n], "chosen": a[n:], "rejected": b[n:]}
        texts = {k: "".join(map(shown, x)) for k, x in parts.items()}
        trained = {k: [shown(r) for r in parts[k] if r[2] == "assistant"] for k in ("chosen", "rejected")}
        want[pair] = (bool(a) and bool(b), texts, trained)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", pair_id long, part string").repartition(5)
    got = {}
    for x in sorted(preference_format.format_pairs(df).collect(), key=lambda x: x.block):
        paired, texts, trained = got.setdefault(x.pair_id, (x.paired, Counter(), {"chosen": [], "rejected": []}))
        for k in preference_format.PARTS:
            texts[k] = (texts[k] or "") + x[k]
        for k, spans in trained.items():
            spans += [x[k][s.start : s.end] for s in x[f"{k}_train"]]
    assert {k: (p, dict(t), m) for k, (p, t, m) in got.items()} == want
    assert preference_format.format_pairs(df.limit(0)).count() == 0
    segments = preference_format.format_preferences(df).count()
    assert segments == sum(len(x) for x in talks.values()) - sum(t["prompt"].count("<|end|>") for _, t, _ in want.values())


def test_warc(spark):
    long, tiny = "é" * 80 + "\r\n\r\n<p>", "x"
    data = [(4, "http://a/b c\nd", long), (2, None, long), (9, "u", tiny), (7, "u", tiny), (5, "u", None), (None, "u", long), (6, "http://z/", "y" * 70_000)]
    pages = spark.createDataFrame([(*x, 1) for x in data], "page_id long, url string, html string, payload long")
    path = scratch(spark, "w")
    warc.write_warc(pages, path)
    got = {x.page_id: x for x in warc.read_warc(spark, path).collect()}
    assert {k: x.record_type for k, x in got.items()} == {4: "revisit", 2: "response", 9: "response", 7: "response", 5: "response", None: "revisit", 6: "response"}
    for k, _, html in data:
        raw = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert got[k].refers_to == (2 if k in (4, None) else None)
        assert got[k].payload is None if got[k].record_type == "revisit" else bytes(got[k].payload) == raw
    some = warc.read_warc(spark, path).filter("record_type = 'revisit' and target_uri like 'http://a%'")
    assert [x.page_id for x in some.collect()] == [4]
    lean = warc.read_warc(spark, path, payload=False).collect()
    assert len(lean) == 7 and all(x.payload is None for x in lean)
    empty = scratch(spark, "w")
    warc.write_warc(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_payloads_of_other_records(spark, tmp_path):
    import gzip

    def record(kind, block):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{kind}>\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    blocks = {"conversion": b"Plain text\r\n\r\nof a page", "resource": b"x" * 5000, "request": b"GET / HTTP/1.1\r\nHost: a\r\n\r\nbody", "revisit": b"HTTP/1.1 200 OK\r\n\r\n"}
    (tmp_path / "a.warc").write_bytes(b"".join(record(k, x) for k, x in blocks.items()))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(k, x)) for k, x in blocks.items()))
    got = warc.read_warc(spark, tmp_path.as_uri()).collect()
    want = blocks | {"request": b"body", "revisit": None}
    assert len(got) == 8 and all((x.payload and bytes(x.payload)) == want[x.record_type] for x in got)
    assert all(x.payload_bytes == len(want[x.record_type]) for x in got if x.record_type != "revisit")


def test_warc_foreign(spark, tmp_path):
    """A plain file, and a gzip file whose members don't say how long they are."""
    import gzip

    def record(n):
        body = b"HTTP/1.1 200 OK\r\n\r\n" + b"p" * n
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{n}>\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        return head + body + b"\r\n\r\n"

    (tmp_path / "a.warc").write_bytes(record(3) + record(5000))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(7)) + gzip.compress(record(90_000)))
    got = warc.read_warc(spark, tmp_path.as_uri()).collect()
    assert sorted(len(x.payload) for x in got) == [3, 7, 5000, 90_000]
    lean = warc.read_warc(spark, tmp_path.as_uri(), payload=False).collect()
    assert {x.record_id for x in lean} == {"<3>", "<7>", "<5000>", "<90000>"}


def warc_record(kind, block, *headers):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{len(block)}>", *headers, f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_warc_digests(spark, tmp_path):
    """Digests of other algorithms are verified, and predicates on the SHA-256 lose no record that doesn't state it."""
    import base64
    import gzip

    body = b"HTTP/1.1 200 OK\r\n\r\n" + b"p" * 500
    raw = body[19:]
    sha1 = base64.b32encode(hashlib.sha1(raw).digest()).decode()
    sha256 = hashlib.sha256(raw)
    headers = [f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Payload-Digest: SHA-1:{hashlib.sha1(raw).hexdigest()}", f"WARC-Payload-Digest: sha256:{base64.b32encode(sha256.digest()).decode()}",
               f"WARC-Payload-Digest: sha256:{sha256.hexdigest()}", "WARC-Payload-Digest: sha1:" + "A" * 32, "WARC-Payload-Digest: blake9:xx", "X-Page-Id: seven", "X-Folded: a\r\n b"]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(warc_record("response", body, h)) for h in headers))
    (tmp_path / "b.warc").write_bytes(b"".join(warc_record("response", body, h) for h in headers))
    rows = warc.read_warc(spark, tmp_path.as_uri()).collect()
    assert len(rows) == 16 and {x.payload_digest for x in rows} == {sha256.hexdigest()} and all(bytes(x.payload) == raw for x in rows)
    assert sorted(str(x.damage) for x in rows) == ["None"] * 14 + ["digest"] * 2
    df = warc.read_warc(spark, tmp_path.as_uri())
    assert df.filter(F.col("payload_digest") == sha256.hexdigest()).count() == 16 and df.filter("payload_digest = 'x'").count() == 0
    lean = warc.read_warc(spark, tmp_path.as_uri(), payload=False)
    assert lean.filter("payload_digest is not null").count() == 4 and lean.filter(F.col("payload_digest") == sha256.hexdigest()).count() == 4


def test_warc_damage(spark, tmp_path):
    """Truncated files, members that don't inflate, missing lengths and rubbish are told, and the rest is read."""
    import gzip

    good = [warc_record("resource", b"r" * n) for n in (10, 20, 3000)]
    z = [gzip.compress(x) for x in good]
    bad = bytearray(gzip.compress(warc_record("resource", random.Random(1).randbytes(5000))))
    bad[200:260] = b"\0" * 60
    no_length = good[1].replace(b"Content-Length: 20\r\n", b"")
    files = {
        "cut.warc.gz": z[0] + z[2][:-30], "cut.warc": good[0] + good[2][:-500], "mid.warc.gz": z[0] + bytes(bad) + z[1], "len.warc.gz": gzip.compress(no_length) + z[0],
        "len.warc": no_length + good[0], "rubbish.warc": b"no archive\n" + good[0], "rubbish.warc.gz": b"xx" + z[0], "head.warc": good[0] + b"WARC/1.0\r\nWARC-Type: x", "empty.warc": b"",
    }
    for name, data in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_bytes(data)
    read = lambda name: sorted((str(x.damage), len(x.payload or b"")) for x in warc.read_warc(spark, (tmp_path / name).as_uri()).collect())
    got = {name: read(name) for name in files}
    assert got == {
        "cut.warc.gz": [("None", 10), ("truncated", 0)], "cut.warc": [("None", 10), ("truncated", 0)], "mid.warc.gz": [("None", 10), ("None", 20), ("gzip", 0)],
        "len.warc.gz": [("None", 10), ("length", 0)], "len.warc": [("None", 10), ("length", 0)], "rubbish.warc": [("None", 10), ("header", 0)],
        "rubbish.warc.gz": [("header", 0)], "head.warc": [("None", 10), ("truncated", 0)], "empty.warc": [],
    }


def test_warc_split(tmp_path, monkeypatch):
    """Parts of a compressed file have each record once, wherever they are cut."""
    import gzip

    rng = random.Random(4)
    records = [warc_record("resource", rng.randbytes(rng.randrange(3000))) for _ in range(60)]
    own = [warc.member("response", k, "u", b"q" * k, hashlib.sha256(b"q" * k).hexdigest(), k, None) for k in range(40)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join([*map(gzip.compress, records), *own]))
    for size in (700, 5000, 1 << 20):
        monkeypatch.setattr(warc, "PARTITION_BYTES", size)
        reader = warc.WarcReader(tmp_path.as_uri(), True, True)
        parts = reader.partitions()
        got = [x for p in parts for b in reader.read(p) for x in b.to_pylist()]
        assert len(got) == 100 and not any(x["damage"] for x in got) and (len(parts) > 1) == (size < 1 << 20)
    assert [p.parts for p in warc.WarcReader((tmp_path / "a.warc.gz").as_uri().replace("a.warc.gz", ""), True, True).partitions()]


def test_codes_follow_the_vocabulary():
    """A worker that has met another vocabulary must not keep its codes."""
    word = b"word"

    def vocabulary(words):
        hashes = pa.array([maxent_lm.word_hash(w) for w in words], pa.int64())
        tails = pa.array([maxent_lm.tail_class(w) for w in words], pa.int8())
        counts = pa.array(range(len(words), 0, -1), pa.int64())
        masses = dict.fromkeys(range(maxent_lm.TAILS), 9)
        return maxent_lm.Vocabulary(pa.table({"w": hashes, "tail": tails, "c": counts}), 9, len(words), 1, masses)

    first, second = vocabulary([b"a", b"b", word]), vocabulary([word])
    assert maxent_lm.codes(first).of([[word, b"a"], []])[0].tolist() == [2, 0]
    got = maxent_lm.codes(second).of([[word, b"a", word]])[0].tolist()
    assert got == [0, -1 - maxent_lm.tail_class(b"a"), 0]


def test_segment_sums():
    rng = np.random.default_rng(0)
    n = np.array([1, 7, 2, 1, 64, 3, 33])
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    x = rng.integers(0, 100, (n.sum(), 5)).astype(np.float32)
    want = np.add.reduceat(x, first, axis=0)
    assert (maxent_lm.segment_sums(x.copy(), first, n) == want).all()


def test_components(spark):
    """Chains, a star, repeated edges, loops and null ends, and no edges at all."""
    from registra.llm.components import components

    edges = [(k, k + 1) for k in range(20, 60)] + [(500, k) for k in range(501, 560)] + [(3, 2), (2, 3), (3, 2), (9, 9), (None, 4), (7, None), (-5, 2)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {x.u: x.root for x in components(df).collect()}
    want = {k: 20 for k in range(20, 61)} | {k: 500 for k in range(500, 560)} | {3: -5, 2: -5, -5: -5}
    assert {k: got.get(k, k) for k in want} == want and not {9, 4, 7} & {k for k, r in got.items() if k != r}
    assert components(df.limit(0)).count() == 0
