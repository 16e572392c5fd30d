"""Operator 3: license scans as an exact set-similarity join of text blocks with templates.

A block is a line or a run of words across line breaks; a line of more than WINDOW
words is cut into overlapping windows, a run has at most RUN times the template's
words and may begin at any word. A block matches a template when it holds at least
``containment`` of the template's distinct tokens. Template tokens are ordered by
their frequency in the whole corpus, rarest first. The join is exact: of m tokens
at least o must be there, so a match holds one of the first m - o + 1 (prefix
filter), has o distinct tokens itself (length filter), and, counted from its first
common token at place p, can still reach o out of m - p (positional filter). The
whole text passes these filters before its runs are searched. The templates are a
fixed set, so their index travels with the code.

Each match is then checked for the words that name the license: a notice that differs
from a template in just these is another license's. Where the places of two matches
overlap and one template has all the naming words of the other and further ones, a match
of the other that holds the further ones gives way: a share-alike notice isn't a plain one.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Fixed phrases of the contract and their labels.
PHRASES = ((b"gnu general public license", "gpl"), (b"apache license", "apache"), (b"cc by", "cc-by"), (b"mit license", "mit"))
#: Notices as their public licenses word them, and the words without which a text is not that license's.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "software charge"),
    ("mit", "Released under the MIT License.", "mit"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "software fee"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "apache"),
    ("apache", "Licensed under the Apache License, Version 2.0.", "apache"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general public"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general public"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mozilla"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons sharealike"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc nc"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
)
CONTAINMENT = 0.8
WINDOW = 256
#: A run across line breaks has at most so many times the template's words: room for comment leaders and names put in.
RUN = 2
KEEP_LINES = bytes(10 if c == 10 else C.WORDS[c] for c in range(256))


class TemplateIndex:
    """The templates' prefixes under a global token order."""

    def __init__(self, templates: Iterable[tuple[str, ...]], containment: float, counts: dict[bytes, int]) -> None:
        self.templates: list[tuple[str, list[bytes], int]] = []
        self.widths: list[int] = []
        self.naming: list[frozenset[bytes]] = []
        self.prefixes: dict[bytes, list[int]] = {}
        for label, text, *naming in templates:
            self.naming.append(frozenset(C.alnum_words(" ".join(naming).encode())))
            words = C.alnum_words(text.encode())
            tokens = sorted(set(words), key=lambda t: (counts.get(t, 0), t))
            need = max(1, math.ceil(containment * len(tokens) - 1e-9))
            for t in tokens[: len(tokens) - need + 1]:
                self.prefixes.setdefault(t, []).append(len(self.templates))
            self.templates.append((label, tokens, need))
            self.widths.append(RUN * len(words))
        self.first = frozenset(self.prefixes)
        held = [frozenset(tokens) for _, tokens, _ in self.templates]
        n = range(len(held))
        #: For each template those to which it may give way, and their further naming words.
        self.over = [{j: self.naming[j] - held[i] for j in n if self.naming[i] <= held[j] and self.naming[i] and not self.naming[j] <= held[i]} for i in n]

    def matches(self, block: set[bytes]) -> Iterator[tuple[int, float]]:
        """(template, containment) of each template that the block matches and has the naming words of."""
        for k in sorted({k for t in self.first & block for k in self.prefixes[t]}):
            _, tokens, need = self.templates[k]
            if len(block) < need or not self.naming[k] <= block:
                continue
            common, left = 0, len(tokens)
            for t in tokens:
                common += t in block
                left -= 1
                if common + left < need:
                    break
            else:
                yield k, common / len(tokens)

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, float, int, int]]:
        """(template, containment, start, end) of the runs that match a template, see best_runs."""
        for k, _ in self.matches(set(words)):
            _, tokens, need = self.templates[k]
            for n, start, end in best_runs(words, frozenset(tokens), need, self.widths[k], self.naming[k]):
                yield k, n / len(tokens), start, end

    def strongest(self, found: list[tuple[int, int, int, float]], words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """The matches (start, end, template, containment) by place, without those that give way to one that they overlap."""
        found, out = sorted(found), []
        before: list[tuple[int, int, int, float]] = []
        for i, (a, b, k, part) in enumerate(found):
            before = [x for x in before if x[1] > a]
            if self.over[k]:
                after = itertools.takewhile(lambda x, b=b: x[0] < b, itertools.islice(found, i + 1, None))
                rivals = {x[2] for x in itertools.chain(before, after)} & self.over[k].keys()
                if rivals and any(self.over[k][j] <= set(words[a:b]) for j in rivals):
                    before.append((a, b, k, part))
                    continue
            out.append((a, b, k, part))
            before.append((a, b, k, part))
        return out


def blocks(words: list[bytes], window: int = WINDOW) -> Iterator[tuple[int, list[bytes]]]:
    """(start, words) of the windows of a line: half overlapping, the last one flush with the end."""
    n = len(words)
    if n <= window:
        yield 0, words
        return
    for start in [*range(0, n - window, window // 2), n - window]:
        yield start, words[start : start + window]


def best_runs(words: list[bytes], tokens: frozenset[bytes], need: int, width: int, naming: frozenset[bytes] = frozenset()) -> list[tuple[int, int, int]]:
    """(distinct tokens, start, end) of runs of at most width words with need distinct tokens and all of naming, by start.

    Each such run ends with the shortest one that still has need tokens. Of these,
    leftmost ones that share no word are picked by their last words, so every run
    holds a picked word. For each picked word the run around it with the most
    tokens, then the shortest, stands for all others.
    """
    at = [i for i, w in enumerate(words) if w in tokens]
    wide, tight = Counter(), Counter()
    full, picked = [], []
    a = b = 0
    for i in at:
        wide[words[i]] += 1
        while at[a] <= i - width or wide[words[at[a]]] > 1:
            a = _drop(wide, words, at, a)
        tight[words[i]] += 1
        while len(tight) > need or len(tight) == need and tight[words[at[b]]] > 1:
            b = _drop(tight, words, at, b)
        if len(wide) >= need:
            if naming <= wide.keys():
                full.append((len(wide), at[a], i + 1))
            if not picked or at[b] > picked[-1]:
                picked.append(i)
    best: dict[int, tuple[int, int, int]] = {}
    for run in full:
        for x in picked[bisect_left(picked, run[1]) : bisect_left(picked, run[2])]:
            if x not in best or (run[0], run[1] - run[2]) > (best[x][0], best[x][1] - best[x][2]):
                best[x] = run
    return sorted(set(best.values()), key=lambda run: run[1:])


def _drop(held: Counter[bytes], words: list[bytes], at: list[int], left: int) -> int:
    w = words[at[left]]
    held[w] -= 1
    if not held[w]:
        del held[w]
    return left + 1


def count_tokens(docs: DataFrame, templates: Iterable[tuple[str, ...]] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text") -> dict[bytes, int]:
    """Occurrences in the whole corpus of each template token. At most as many rows reach the driver as the templates have tokens."""
    vocab = frozenset(w for _, t, *_ in templates for w in C.alnum_words(t.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, C.SLICE_ROWS):
                for raw in batch.column(0).slice(at, C.SLICE_ROWS).cast(pa.binary()).to_pylist():
                    counts.update(filter(vocab.__contains__, C.alnum_words(raw or b"")))
        yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    rows = C.text_rows(docs, id_col, text_col).select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"].encode(): r["n"] for r in rows}


def places(words: list[bytes], text: bytes, phrase: bytes) -> list[int]:
    """Word indexes at which the phrase's words stand consecutively. text: the words between single spaces, one at each end."""
    key, out, at, counted, n = b" " + phrase + b" ", [], -1, 0, 0
    while (at := text.find(key, at + 1)) >= 0:
        n += text.count(b" ", counted, at)
        counted = at
        out.append(n)
    return out


def _inside(held: list[tuple[int, int]], start: int, end: int) -> bool:
    """Is the run inside one of the blocks, which come by start and end alike?"""
    i = bisect_right(held, start, key=lambda x: x[0])
    return i > 0 and held[i - 1][1] >= end


def _scanner(index: TemplateIndex) -> Callable[[], Callable[[list[bytes]], list[list]]]:
    def one(raw: bytes) -> tuple:
        lines = [line.split() for line in raw.translate(KEEP_LINES).split(b"\n")]
        words = [w for line in lines for w in line]
        text = b" ".join([b"", *words, b""])
        base = [(p, label) for phrase, label in PHRASES for p in places(words, text, phrase)]
        found, at = [], 0
        for line in lines:
            if not index.first.isdisjoint(line):
                for start, block in blocks(line):
                    found += [(at + start, at + start + len(block), k, part) for k, part in index.matches(set(block))]
            at += len(line)
        in_lines: dict[int, list[tuple[int, int]]] = {}
        for a, b, k, _ in found:
            in_lines.setdefault(k, []).append((a, b))
        found += [(start, end, k, part) for k, part, start, end in index.runs(words) if not _inside(in_lines.get(k, []), start, end)]
        found = index.strongest(found, words)
        labels = {label for _, label in base} | {index.templates[k][0] for _, _, k, _ in found}
        score = 1.0 if base else max((part for *_, part in found), default=0.0)
        said = [f"{index.templates[k][0]}:{a}:{b}" for a, b, k, _ in found]
        starts = [p for p, _ in base]
        return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score, ",".join(said))

    return lambda: lambda texts: [list(x) for x in zip(*map(one, texts), strict=True)] if texts else [[] for _ in range(8)]


def scan(docs: DataFrame, templates: Iterable[tuple[str, ...]] = TEMPLATES, *, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks (``label:start:end`` in words).

    ``score`` is the best containment, 1 where a base phrase stands. A null text
    is empty: no words, null places, empty labels. Repeated rows give repeated
    results, an empty table none; other columns are not read. A text of any length is
    read whole, in the memory that its words take.
    """
    templates = tuple(templates)
    index = TemplateIndex(templates, containment, count_tokens(docs, templates, id_col=id_col, text_col=text_col))
    fields = [C.long("n_words"), C.long("n_base"), C.long("first_word"), C.long("last_word"), C.string("base_labels"), C.string("labels"), C.double("score"), C.string("blocks")]
    return C.map_texts(C.text_rows(docs, id_col, text_col), _scanner(index), fields)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"))
