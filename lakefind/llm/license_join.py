"""License scan as an exact set-similarity join of text blocks with templates.

A text block is a line, or a run of consecutive lines with as many tokens at most
as ``slack`` times the template's, so that a notice is found however it is
wrapped; a line without tokens ends a run.  A block meets a template if it has at
least ``threshold`` of the template's distinct tokens (containment).  Tokens are
ordered by how many lines of the whole corpus have them, rarest first.  For a
template of n tokens that needs o of them,

* prefix filter: a block with o common tokens has one of the template's n-o+1
  rarest;
* length filter: the block has at least o tokens of the templates' vocabulary;
* positional filter: after a common token at places i and j, at most
  1 + min(n-i-1, m-j-1) tokens can be common, m being the block's tokens.

What passes is counted exactly, so nothing is missed and nothing is approximate.
Tokens that no template has cannot be common; they are left out of blocks.  Runs
are looked for around each line that has a prefix token, where the lines within
reach have o tokens of the template at all.

Two passes over the texts, neither of which shuffles them: one counts the
vocabulary's tokens, one probes.  Templates are what tasks receive; they are a
parameter and do not grow with the corpus.

Defined results
---------------
* Tokens are those of ``tokens.py``; a token counts once in a block.
* Every line that meets a template is a row, as often as it is repeated, and
  every run of lines that meets it while no shorter run within does; ties between
  templates are all reported.  Lines are numbered from 0, last_line is included.
* Null and empty texts have no blocks; a template without tokens meets nothing.
  Null doc_ids are carried along.
* An empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as tk
from .common import as_strings, bounded_batches, col, column_of, expand_ranges, slices

_PIECE = 4 << 20

#: Notices by which licences are recognised.
TEMPLATES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "reserved": "All rights reserved.",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-grant": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


class Index:
    """Templates as token sets over a common vocabulary."""

    def __init__(self, templates: dict[str, str], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be above 0 and at most 1")
        seqs = [(name, np.unique(h)) for name, h in zip(templates, tk.text_hashes(list(templates.values()))) if len(h)]
        self.names = [n for n, _ in seqs]
        self.reach = {n: len(h) for n, h in zip(templates, tk.text_hashes(list(templates.values())))}
        self.words = np.unique(np.concatenate([h for _, h in seqs])) if seqs else np.zeros(0, np.uint64)
        self.sets = [np.searchsorted(self.words, h) for _, h in seqs]
        self.need = np.array([max(1, ceil(threshold * len(s) - 1e-9)) for s in self.sets], np.int64)

    def order_by(self, counts: np.ndarray) -> None:
        """Fix the global order from the words' block counts and build the prefix index."""
        n = len(self.words)
        rank = np.empty(n, np.int64)
        rank[np.lexsort((self.words, counts))] = np.arange(n)
        self.rank = rank
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.member = np.zeros((len(self.sets), n), bool)
        post = []
        for i, s in enumerate(self.sets):
            r = np.sort(rank[s])
            self.member[i, r] = True
            post += [(int(w), i, j) for j, w in enumerate(r[: len(r) - self.need[i] + 1])]
        post.sort()
        self.post_word = np.array([p[0] for p in post], np.int64)
        self.post_set = np.array([p[1] for p in post], np.int64)
        self.post_place = np.array([p[2] for p in post], np.int64)


def _blocks(b: pa.RecordBatch, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (line, word number) pairs of a batch, in order, and the row and the number of tokens of every line."""
    lists = pc.split_pattern(as_strings(column_of(b, "t")), "\n")
    rows = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
    t = tk.tokenize(lists.flatten())
    if not len(words) or not len(t.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), rows, t.counts
    at = np.minimum(np.searchsorted(words, t.hash), len(words) - 1)
    hit = np.flatnonzero(words[at] == t.hash)
    block = np.searchsorted(t.doc, hit, "right") - 1
    key = np.unique(block * len(words) + at[hit])
    return key // len(words), key % len(words), rows, t.counts


def probe(block: np.ndarray, rank: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks and templates that meet: (block, template number, common tokens); pairs sorted by block and rank."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(block):
        return none
    new = np.append(True, block[1:] != block[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(block)), 0))
    place = np.arange(len(block)) - first
    start = np.flatnonzero(new)
    size = np.repeat(np.diff(np.append(start, len(block))), np.diff(np.append(start, len(block))))
    who, p = expand_ranges(np.searchsorted(index.post_word, rank, "left"), np.searchsorted(index.post_word, rank, "right"))
    s = index.post_set[p]
    most = 1 + np.minimum(index.sizes[s] - index.post_place[p] - 1, size[who] - place[who] - 1)
    # tokens before this one may be common as well; the first common token is the one that has to pass
    pair = np.unique((first[who] * len(index.names) + s)[(size[who] >= index.need[s]) & (most >= index.need[s])])
    if not len(pair):
        return none
    lo, s = pair // len(index.names), pair % len(index.names)
    who, at = expand_ranges(lo, lo + size[lo])
    common = np.bincount(who, index.member[s[who], rank[at]], len(pair)).astype(np.int64)
    ok = common >= index.need[s]
    return block[lo[ok]], s[ok], common[ok]


def runs(line: np.ndarray, rank: np.ndarray, rows: np.ndarray, counts: np.ndarray, index: Index, slack: float) -> list[tuple[int, int, int, int]]:
    """Shortest runs of at least two lines that meet a template: (first line, last line, template number, common tokens).

    line and rank are the distinct tokens of all lines, sorted; rows and counts
    are each line's row and number of tokens.
    """
    if not len(line):
        return []
    n = len(counts)
    ends = np.append(0, np.cumsum(counts))
    # a part is what runs stay in: lines of one row up to one without tokens
    part = np.cumsum(np.append(True, rows[1:] != rows[:-1]) | (counts == 0))
    first_of = np.searchsorted(part, part, "left")
    first_of = first_of + (counts[first_of] == 0)
    last_of = np.searchsorted(part, part, "right") - 1
    hits = np.searchsorted(line, np.arange(n + 1))
    who, p = expand_ranges(np.searchsorted(index.post_word, rank, "left"), np.searchsorted(index.post_word, rank, "right"))
    out = []
    for s in np.unique(index.post_set[p]):
        cap = int(slack * index.reach[index.names[s]])
        seed = np.unique(line[who[index.post_set[p] == s]])
        lo = np.maximum(first_of[seed], np.searchsorted(ends, ends[seed + 1] - cap, "left"))
        hi = np.minimum(last_of[seed], np.searchsorted(ends, ends[seed] + cap, "right") - 2)
        inside = np.append(0, np.cumsum(index.member[s, rank]))
        some = (hi > lo) & (lo <= seed) & (hi >= seed)
        seed, lo, hi = seed[some], lo[some], hi[some]
        some = inside[hits[hi + 1]] - inside[hits[lo]] >= index.need[s]
        lo, hi = lo[some], hi[some]
        if not len(lo):
            continue
        # reaches that overlap are searched together
        new = np.append(True, lo[1:] > np.maximum.accumulate(hi)[:-1])
        start = np.flatnonzero(new)
        for a, b in zip(lo[start], np.maximum.reduceat(hi, start)):
            mine = {x: [int(w) for w in rank[hits[x] : hits[x + 1]] if index.member[s, w]] for x in range(int(a), int(b) + 1)}
            have: dict[int, int] = {}
            i, before = int(a), -1
            for j in mine:
                for w in mine[j]:
                    have[w] = have.get(w, 0) + 1
                if len(have) < index.need[s]:
                    continue
                # the latest line that a run up to j can begin at; shortest if no run up to j - 1 could begin there
                while i < j and len(have) - sum(have[w] == 1 for w in mine[i]) >= index.need[s]:
                    for w in mine[i]:
                        have[w] -= 1
                        if not have[w]:
                            del have[w]
                    i += 1
                if i > before and i < j and ends[j + 1] - ends[i] <= cap:
                    out.append((i, j, int(s), len(have)))
                before = i
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, doc_id="doc_id", text="text", threshold: float = 0.8, slack: float = 2.0) -> DataFrame:
    """Blocks that meet a template: doc_id, line, last_line, template, common_tokens, containment."""
    index = Index(TEMPLATES if templates is None else templates, threshold)
    narrow = bounded_batches(docs).select(col(docs, doc_id).alias("d"), col(docs, text).alias("t")).where(F.col("t").isNotNull())

    def count(batches):
        total = np.zeros(len(index.words), np.int64)
        for b in slices(batches, "t", _PIECE):
            total += np.bincount(_blocks(b, index.words)[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["w", "n"])

    counts = np.zeros(len(index.words), np.int64)
    for r in narrow.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect():
        counts[r["w"]] = r["n"]
    index.order_by(counts)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("line", T.IntegerType()), T.StructField("last_line", T.IntegerType()), T.StructField("template", T.StringType()), T.StructField("common_tokens", T.IntegerType()), T.StructField("containment", T.DoubleType())])

    def find(batches):
        names = pa.array(index.names, pa.string())
        for b in slices(batches, "t", _PIECE):
            line, word, rows, counts = _blocks(b, index.words)
            rank = index.rank[word]
            o = np.lexsort((rank, line))
            line, rank = line[o], rank[o]
            block, s, common = probe(line, rank, index)
            more = np.array(runs(line, rank, rows, counts, index, slack), np.int64).reshape(-1, 4)
            first, last = np.append(block, more[:, 0]), np.append(block, more[:, 1])
            s, common = np.append(s, more[:, 2]), np.append(common, more[:, 3])
            if not len(first):
                continue
            base = np.searchsorted(rows, rows[first])
            yield pa.RecordBatch.from_arrays(
                [column_of(b, "d").take(pa.array(rows[first])), pa.array(first - base, pa.int32()), pa.array(last - base, pa.int32()), names.take(pa.array(s)), pa.array(common, pa.int32()), pa.array(common / index.sizes[s])],
                names=schema.names,
            )

    return narrow.mapInArrow(find, schema)
