"""License scans by patience alignment.

Texts and templates are compared as normalized words (lower case, letters and digits only). Only a text's hits, the words
that occur in the template, are aligned, so foreign words between them don't matter. An alignment that reaches
`threshold` begins with one of the template's first words; from each hit with such a word the text is looked at as far as
a notice may be stretched: `stretch(n)` foreign words beside the template's n (short notices must be nearly verbatim, long
ones may hold twice their length). Where the words there, counted with their repeats, could cover enough of the template
(a bound that is exact), they are aligned: match the common head and tail; anchor on words that occur once on both sides;
keep the longest increasing subsequence of anchors; align the gaps between them in the same way. Coverage is the share of
the template's words that are aligned. A template is found where coverage reaches `threshold`.

Whole texts are read; batches are cut by bytes.

Defined results: null and empty texts have no license; very long texts are scanned whole; of equal coverage the earlier
span counts, as its shortest stretch, and templates are reported in name order; repeated rows give equal rows; an empty
table gives no rows; extra columns pass through, but for one named licenses, which is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, runs_of

THRESHOLD = 0.8
_WORD = re.compile(r"[^\W_]+")

#: Short notices by which a text names its license, and heads of well-known license texts (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def stretch(n: int) -> int:
    """Foreign words that a notice of n words may hold."""
    return n // 2 if n < 20 else 2 * n


def normal_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience alignment: increasing pairs (place in a, place in b) of equal words."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {w for w, n in ca.items() if n == 1 and cb.get(w) == 1}
        if not once:
            continue
        where = {a[i]: i for i in range(a0, a1) if a[i] in once}
        pairs = [(where[b[j]], j) for j in range(b0, b1) if b[j] in once]
        # Longest increasing subsequence in a's places, by patience piles with back links.
        tops: list[int] = []
        pile: list[int] = []
        back = [-1] * len(pairs)
        for k, (i, _) in enumerate(pairs):
            p = bisect_left(tops, i)
            back[k] = pile[p - 1] if p else -1
            if p == len(tops):
                tops.append(i)
                pile.append(k)
            else:
                tops[p], pile[p] = i, k
        chain, k = [], pile[-1]
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        pa_, pb_ = a0, b0
        for i, j in reversed(chain):
            out.append((i, j))
            todo.append((pa_, i, pb_, j))
            pa_, pb_ = i + 1, j + 1
        todo.append((pa_, a1, pb_, b1))
    return sorted(out)


class Scanner:
    """Templates as word lists, and the scan of one batch of texts."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.names = sorted(templates)
        self.words = [normal_words(templates[n]) for n in self.names]
        self.bit = {}
        for k, ws in enumerate(self.words):
            for w in ws:
                self.bit[w] = self.bit.get(w, 0) | 1 << k
        self.kinds = [len(set(ws)) for ws in self.words]
        #: Template words that must be aligned, and may be missing.
        self.need = [next(m for m in range(len(ws) + 1) if m / len(ws) >= threshold) for ws in self.words]
        spare = [len(ws) - m for ws, m in zip(self.words, self.need, strict=True)]
        # The missing words all counted as different ones: the least number of different words needed.
        self.least = [max(1, d - x) for d, x in zip(self.kinds, spare, strict=True)]
        self.heads = [set(ws[: x + 1]) for ws, x in zip(self.words, spare, strict=True)]

    def windows(self, k: int, at: np.ndarray, hits: list[str]) -> Iterator[tuple[int, int]]:
        """Ranges of hits, each from a head word as far as a notice may reach, that could cover enough of template k."""
        left = Counter(self.words[k])  # what of the template the range does not cover yet; negative where it has more
        reach = len(self.words[k]) + stretch(len(self.words[k]))
        covered = e = 0
        for s in range(len(at)):
            while e < len(at) and at[e] < at[s] + reach:
                covered += left[hits[e]] > 0
                left[hits[e]] -= 1
                e += 1
            if covered >= self.need[k] and hits[s] in self.heads[k]:
                yield s, e
            left[hits[s]] += 1
            covered -= left[hits[s]] > 0

    def scan(self, words: list[str]) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, last word + 1) of the templates found, in name order."""
        bits = np.fromiter((self.bit.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        out = []
        for k, name in enumerate(self.names):
            at = np.flatnonzero(bits >> k & 1)
            if len(at) < self.need[k]:
                continue
            best, template, hits = None, self.words[k], [words[i] for i in at]
            for s, e in self.windows(k, at, hits):
                pairs = align(hits[s:e], template)
                if len(pairs) < self.need[k] or best and len(pairs) < best[0]:
                    continue
                # The common tail may lie beyond the notice's own end: the shortest range that covers as much.
                for end in range(s + len(pairs), e):
                    fewer = align(hits[s:end], template)
                    if len(fewer) >= len(pairs):
                        pairs = fewer
                        break
                found = (len(pairs), int(at[s + pairs[0][0]]), int(at[s + pairs[-1][0]]) + 1)
                if best is None or found[0] > best[0] or (found[1] >= best[1] and found[2] <= best[2]):
                    best = found
                if best[0] == len(template) == best[2] - best[1]:
                    break
            if best:
                out.append((name, best[0] / len(template), best[1], best[2]))
        return out

    def possible(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold enough different words of some template: a bound from white-space pieces, in bulk."""
        lists = pc.ascii_split_whitespace(texts)
        pieces = lists.flatten().dictionary_encode()
        kinds = pieces.dictionary.to_pylist()
        of = [[self.vocab_id(w) for w in normal_words(k) if w in self.bit] for k in kinds]
        most = max((len(x) for x in of), default=0)
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        doc = np.repeat(np.arange(len(texts)), np.diff(ends))
        idx = pieces.indices.to_numpy(zero_copy_only=False)
        seen = np.zeros((len(texts), len(self.bit)), dtype=bool)
        for c in range(most):
            col = np.array([x[c] if len(x) > c else -1 for x in of], dtype=np.int64)
            v = col[idx]
            seen[doc[v >= 0], v[v >= 0]] = True
        member = np.array([[b >> k & 1 for k in range(len(self.names))] for b in self.bit.values()], dtype=np.int64)
        return (seen.astype(np.int64) @ member >= np.array(self.least)).any(axis=1)

    def vocab_id(self, word: str) -> int:
        if not hasattr(self, "_ids"):
            self._ids = {w: i for i, w in enumerate(self.bit)}
        return self._ids[word]


FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType())]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the text, with licenses: an array of (license, coverage, start_word, end_word)."""
    keep = [c for c in docs.columns if c not in (text_col, "licenses")]
    src = docs.select(*keep, text_col)
    schema = T.StructType([*src.drop(text_col).schema.fields, T.StructField("licenses", FOUND)])
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for b in batches:
            texts = pc.fill_null(b.column(b.num_columns - 1), "")
            found: list[list[dict]] = [[] for _ in range(len(texts))]
            sizes = pc.binary_length(texts).to_pylist()
            for i, j in runs_of(sizes, 8 << 20):
                part = texts.slice(i, j - i)
                for d in np.flatnonzero(scanner.possible(part)):
                    found[i + d] = [dict(zip(("license", "coverage", "start_word", "end_word"), x, strict=True)) for x in scanner.scan(normal_words(part[int(d)].as_py()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], [*b.schema.names[:-1], "licenses"])

    return src.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its best license (highest coverage, then name), or null, and how many templates it holds."""
    found = scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    top = F.get(F.array_sort("licenses", lambda a, b: F.when(a["coverage"] > b["coverage"], -1).when(a["coverage"] < b["coverage"], 1).when(a["license"] < b["license"], -1).otherwise(1)), 0)
    return found.select("doc_id", top["license"].alias("license"), F.coalesce(top["coverage"], F.lit(0.0)).alias("coverage"), top["start_word"].alias("start_word"), top["end_word"].alias("end_word"), F.size("licenses").cast("long").alias("n_licenses"))
