"""License scans: an exact set-similarity join of text blocks with license notices.

A template's blocks are all runs of n / threshold consecutive words (n: the template's words, repeats included) of
the whole text, so that a notice may wrap over lines, and words scattered over a longer line don't make one.
A block matches a template when at least ``threshold`` of the template's distinct words are in the block.
Words that no template has can't take part; the rest get one global order, rarest first, from counts
over all texts of the table. A text that fails a filter has no matching block. For a template of t words, of
which a = ceil(threshold * t) must be there:

* prefix: the text must have one of the template's t - a + 1 rarest words,
* length: the text must have a template words at least,
* position: from the first common word on, both must have enough words left to come to a,
* then the words common to both are counted,
* and for the templates left, those in each block, by a window that slides over the template's words in the text.

The SQL knows lines as blocks only: it gives other labels for notices that wrap and for scattered words.

Beside it stand fixed phrases (the base), found wherever their words stand consecutively.

Defined results: null and empty texts have no words and no labels; a word that a block repeats counts
once; ties and repeated documents are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, prepare, table, utf8

#: The base's phrases and labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices of public licenses and the labels that they give.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("odbl-1.0", "This database is made available under the Open Database License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.9


def line_words(text: str | None) -> list[list[bytes]]:
    return [x.translate(ALNUM).split() for x in utf8(text).split(b"\n")]


def need(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


class Index:
    """Templates in the global order, with their prefixes by word."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float):
        sets = [set(t.encode().translate(ALNUM).split()) for _, t in templates]
        order = sorted(set().union(*sets), key=lambda w: (counts.get(w, 0), w))
        self.place = {w: k for k, w in enumerate(order)}
        self.labels = [x for x, _ in templates]
        self.words = sets
        self.width = [need(len(t.encode().translate(ALNUM).split()), 1 / threshold) for _, t in templates]
        self.templates = [sorted(self.place[w] for w in s) for s in sets]
        self.need = [need(len(s), threshold) for s in sets]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.templates):
            for at, word in enumerate(t[: len(t) - self.need[k] + 1]):
                self.prefix.setdefault(word, []).append((k, at))
        self.rare = frozenset(order[w] for w in self.prefix)

    def matches(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of a text taken as one block."""
        if self.rare.isdisjoint(words):
            return []
        block = sorted(self.place[w] for w in self.place.keys() & set(words))
        seen: set[int] = set()
        out = []
        for j, word in enumerate(block):
            for k, i in self.prefix.get(word, ()):
                if k in seen:
                    continue
                seen.add(k)
                t, a = self.templates[k], self.need[k]
                if len(block) < a or 1 + min(len(t) - i - 1, len(block) - j - 1) < a:
                    continue
                common = len(set(t).intersection(block))
                if common >= a:
                    out.append((k, common / len(t)))
        return sorted(out)

    def blocks(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(first word, template, containment) of the matching blocks; of those that overlap, the first of the best."""
        out = []
        for k, _ in self.matches(words):
            own, width, a = self.words[k], self.width[k], self.need[k]
            at = [i for i, w in enumerate(words) if w in own]
            n: Counter[bytes] = Counter()
            lo, best = 0, None
            for i in at:
                n[words[i]] += 1
                while at[lo] <= i - width or n[words[at[lo]]] > 1:
                    n[words[at[lo]]] -= 1
                    if not n[words[at[lo]]]:
                        del n[words[at[lo]]]
                    lo += 1
                if len(n) < a:
                    continue
                if best and at[lo] > best[1]:
                    out.append((best[0], k, best[2] / len(own)))
                    best = None
                if best is None or len(n) > best[2]:
                    best = (at[lo], i, len(n))
            if best:
                out.append((best[0], k, best[2] / len(own)))
        return sorted(out)


def word_counts(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """In how many texts of docs each template word is. At most a row a template word reaches the driver."""
    vocabulary = frozenset(w for _, t in templates for w in t.encode().translate(ALNUM).split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                n.update(vocabulary.intersection(utf8(text).translate(ALNUM).split()))
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(n), pa.binary()), "n": pa.array(list(n.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {bytes(x.w): x.n for x in rows.collect()}


def base_hits(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of all places of the phrases."""
    out = []
    for phrase, label in PHRASES.items():
        p = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(p[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(p)] == p:
                out.append((at, label))
    return out


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string,"
    " labels string, score double, blocks array<struct<block:long,label:string,containment:double>>"
)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The contract's columns and blocks: every matching (line number of the first word, label, containment)."""
    prepare(docs.sparkSession)
    index = Index(templates, word_counts(docs, templates), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = frozenset(p.split()[0].encode() for p in PHRASES)
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                lines = line_words(text)
                words = [w for x in lines for w in x]
                base = [] if firsts.isdisjoint(words) else base_hits(words)
                blocks = []
                if not index.rare.isdisjoint(words):
                    starts = list(accumulate(map(len, lines)))
                    for at, k, share in index.blocks(words):
                        blocks.append({"block": bisect_right(starts, at), "label": index.labels[k], "containment": share})
                own = {x for _, x in base}
                rows.append(
                    {
                        "doc_id": doc, "n_words": len(words), "n_base": len(base),
                        "first_word": min(base)[0] if base else None, "last_word": max(base)[0] if base else None,
                        "base_labels": ",".join(sorted(own)),
                        "labels": ",".join(sorted(own | {x["label"] for x in blocks})),
                        "score": 1.0 if base else max((x["containment"] for x in blocks), default=0.0),
                        "blocks": blocks,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)


ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("blocks", pa.list_(pa.struct([("block", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))),
    ]
)


def op10_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("blocks")


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(
        f"({k}, {quoted(label)}, [{', '.join(quoted(w.decode()) for w in sorted(set(t.encode().translate(ALNUM).split())))}])"
        for k, (label, t) in enumerate(TEMPLATES)
    )
    phrases = ", ".join(
        f"({quoted(label)}, {len(p.split())}, {quoted(p)})" for p, label in PHRASES.items()
    )
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH tmpl(k, label, t) AS (VALUES {values}), phrase(label, n, p) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS r, doc_id, {low.format("coalesce(text, '')")} AS text FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(text, '{pattern}') AS w, string_split(text, chr(10)) AS l FROM d),
hit AS (
  SELECT r, i - 1 AS pos, phrase.label
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w), phrase
  WHERE array_to_string(w[i : i + n - 1], ' ') = p
), base AS (
  SELECT r, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM hit GROUP BY r
), line AS (SELECT r, list_distinct(regexp_extract_all(x, '{pattern}')) AS b FROM (SELECT r, unnest(l) AS x FROM w)),
match AS (
  SELECT r, label, len(list_intersect(t, b)) / len(t) AS share FROM line, tmpl
  WHERE len(list_intersect(t, b)) >= ceil({THRESHOLD} * len(t) - 1e-9)
), best AS (SELECT r, max(share) AS share FROM match GROUP BY r),
own AS (SELECT r, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT r, label FROM hit) GROUP BY r),
every AS (
  SELECT r, string_agg(label, ',' ORDER BY label) AS s
  FROM (SELECT r, label FROM hit UNION SELECT r, label FROM match) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base,
  CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word, coalesce(own.s, '') AS base_labels,
  coalesce(every.s, '') AS labels,
  CAST(CASE WHEN base.n > 0 THEN 1 ELSE coalesce(best.share, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN best USING (r) LEFT JOIN own USING (r) LEFT JOIN every USING (r)
"""


ORACLE_SQL = _sql()
