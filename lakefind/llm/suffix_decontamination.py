"""Benchmark decontamination with suffix arrays over the training text.

Training documents are cut into shards of bounded size.  Each shard gets the
suffix array of its token sequence; every suffix of every benchmark item is
binary-searched in it, depth by depth, which gives the longest verbatim match
and all its places.  A document with a match as long as the item's threshold is
affected.

A shard is built and searched inside one task, so nothing is shuffled, a lost
task is simply run again, and the cost is linear in the corpus.  The benchmark
is what every task needs: it is sent in slices of bounded size, one pass over
the corpus for each, so what is broadcast never grows with either side.

Defined results
---------------
* Matching is on tokens (see ``tokens.py``): letter case, punctuation and white
  space do not matter.  Matches never run across documents.
* An item's threshold is ``min_tokens``, or its own length if it is shorter; an
  item of fewer than ``min_item_tokens`` tokens names no passage and is ignored.
* Null or empty texts, on either side, match nothing; such documents are kept.
* Rows are decided one by one: repeated rows and repeated or null doc_ids are
  each treated as documents of their own.  Repeated items each report matches.
* An empty table gives an empty result; extra columns, whatever their names,
  pass through :func:`decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as tk
from .common import bounded_batches, col, column_of, expand_ranges, keep_rows, slices

#: Bytes of text in a shard (about one million tokens), and of benchmark text in one pass.
SHARD_BYTES = 6 << 20
BENCHMARK_BYTES = 8 << 20


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Suffix order of a sequence of small non-negative integers.

    Prefix doubling on packed keys: the first sort covers several tokens at
    once, later rounds touch only the suffixes that are still tied.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    ids = ids.astype(np.int64)
    bits = max(1, int(ids.max() + 1).bit_length())
    per = max(1, min(62 // bits, 8))
    key = np.zeros(n, np.int64)
    for j in range(per):
        key <<= bits
        key[: n - j] += ids[j:] + 1 if j < n else 0
    order = np.argsort(key)
    k = key[order]
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    h = per
    while len(tied):
        idx = order[tied]
        after = idx + h
        key = rank[idx] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        o = np.argsort(key)
        idx, key = idx[o], key[o]
        order[tied] = idx
        new = np.ones(len(idx), bool)
        new[1:] = key[1:] != key[:-1]
        rank[idx] = tied[np.maximum.accumulate(np.where(new, np.arange(len(idx)), 0))]
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    return order


def _narrow(ids, sa, lo, hi, depth, want, above):
    """First place in each sa[lo:hi] whose token at depth is >= want (> want if above)."""
    lo, hi = lo.copy(), hi.copy()
    last = len(ids) - 1
    while True:
        act = np.flatnonzero(lo < hi)
        if not len(act):
            return lo
        mid = (lo[act] + hi[act]) >> 1
        t = ids[np.minimum(sa[mid] + depth, last)]
        right = t <= want[act] if above else t < want[act]
        lo[act[right]] = mid[right] + 1
        hi[act[~right]] = mid[~right]


class Items:
    """The benchmark's token sequences with each suffix's threshold."""

    def __init__(self, ids: list, texts: list[str], min_tokens: int, min_item_tokens: int):
        seqs = [(i, h) for i, h in zip(ids, tk.text_hashes(texts)) if len(h) >= max(1, min_item_tokens)]
        self.ids = [i for i, _ in seqs]
        sizes = np.array([len(h) for _, h in seqs], np.int64)
        self.offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
        self.hash = np.concatenate([h for _, h in seqs]) if seqs else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(seqs)), sizes)
        at = np.arange(len(self.hash))
        left = self.offsets[owner + 1] - at
        need = np.minimum(min_tokens, sizes)[owner] if seqs else at
        use = left >= need
        # tasks get a slice's arrays: some 24 bytes a token
        self.start, self.owner, self.left, self.need = (x[use].astype(np.int32) for x in (at, owner, left, need))


def shard_matches(hashes: np.ndarray, docs: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """Maximal matches of the items in one shard.

    hashes: the shard's tokens; docs: where each of its documents begins and
    the end.  Returns arrays (document number, item number, place in item,
    place in document, length).
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    nd = len(docs) - 1
    if not len(hashes) or not len(items.start):
        return none
    words, inv = np.unique(hashes, return_inverse=True)
    # every document ends with a mark of its own, smaller than any token
    n = len(hashes) + nd
    ids = np.empty(n, np.int64)
    owner = np.repeat(np.arange(nd), np.diff(docs))
    ids[np.arange(len(hashes)) + owner] = inv + nd
    first = docs[:-1] + np.arange(nd)
    ids[docs[1:] + np.arange(nd)] = np.arange(nd)
    sa = suffix_array(ids)

    at = np.minimum(np.searchsorted(words, items.hash), len(words) - 1)
    pat = np.where(words[at] == items.hash, at + nd, -1)
    lo, hi = np.zeros(len(items.start), np.int64), np.full(len(items.start), n, np.int64)
    act = np.arange(len(items.start))
    found_s, found_lo, found_hi = [], [], []
    depth = 0
    while len(act):
        want = pat[items.start[act] + depth]
        a = _narrow(ids, sa, lo[act], hi[act], depth, want, False)
        b = _narrow(ids, sa, a, hi[act], depth, want, True)
        lo[act], hi[act] = a, b
        act = act[(a < b) & (want >= 0)]
        depth += 1
        full = items.need[act] == depth
        if full.any():
            done = act[full]
            found_s.append(done)
            found_lo.append(lo[done])
            found_hi.append(hi[done])
            act = act[~full]
    if not found_s:
        return none
    s = np.concatenate(found_s)
    who, place = expand_ranges(np.concatenate(found_lo), np.concatenate(found_hi))
    s, pos = s[who], sa[place]
    q = items.start[s]
    # a place whose left neighbour matches too is part of a longer match
    inside = q > items.offsets[items.owner[s]]
    whole = ~(inside & (pos > 0) & (ids[np.maximum(pos - 1, 0)] == pat[np.maximum(q - 1, 0)]))
    s, pos, q = s[whole], pos[whole], q[whole]
    length = items.need[s].astype(np.int64)
    act = np.flatnonzero(length < items.left[s])
    while len(act):
        more = ids[pos[act] + length[act]] == pat[q[act] + length[act]]
        act = act[more]
        length[act] += 1
        act = act[length[act] < items.left[s[act]]]
    d = np.searchsorted(first, pos, "right") - 1
    item = items.owner[s]
    out = (d, item, q - items.offsets[item], pos - first[d], length)
    order = np.lexsort((out[3], out[2], out[1], out[0]))
    return tuple(x[order] for x in out)


def _benchmark_slices(benchmark: DataFrame, item_id: str, text: str, min_tokens: int, min_item_tokens: int, limit: int) -> Iterator[Items]:
    """The benchmark in slices of at most limit bytes of text each."""
    b = benchmark.select(col(benchmark, item_id).alias("i"), col(benchmark, text).alias("t")).where(F.col("t").isNotNull())
    total = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // limit))
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        rows = sorted(part.collect(), key=lambda r: (r["i"] is not None, r["i"] if r["i"] is not None else 0, r["t"]))
        items = Items([r["i"] for r in rows], [r["t"] for r in rows], min_tokens, min_item_tokens)
        if items.ids:
            yield items


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_tokens: int = 13,
    min_item_tokens: int = 8,
    benchmark_bytes: int = BENCHMARK_BYTES,
) -> DataFrame:
    """Every maximal verbatim match of a benchmark item in a document.

    Columns: doc_id, item_id, item_pos and doc_pos (token numbers from 0) and
    n_tokens.  All places are reported, however many documents share a passage.
    """
    id_type = docs.schema[doc_id].dataType
    item_type = benchmark.schema[item_id].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", item_type)] + [T.StructField(c, T.IntegerType()) for c in ("item_pos", "doc_pos", "n_tokens")])
    narrow = bounded_batches(docs).select(col(docs, doc_id).alias("d"), col(docs, text).alias("t"))
    out = None
    for items in _benchmark_slices(benchmark, item_id, item_text, min_tokens, min_item_tokens, benchmark_bytes):

        def search(batches, items=items):
            for b in slices(batches, "t", SHARD_BYTES):
                t = tk.tokenize(column_of(b, "t"))
                d, i, ip, dp, n = shard_matches(t.hash, t.doc, items)
                if len(d):
                    ids = pa.array([items.ids[x] for x in i])
                    yield pa.RecordBatch.from_arrays([column_of(b, "d").take(pa.array(d)), ids] + [pa.array(x, pa.int32()) for x in (ip, dp, n)], names=["doc_id", "item_id", "item_pos", "doc_pos", "n_tokens"])

        found = narrow.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_tokens: int = 13,
    min_item_tokens: int = 8,
    benchmark_bytes: int = BENCHMARK_BYTES,
) -> DataFrame:
    """The documents without those that a benchmark passage occurs in; columns as they were."""
    out = docs
    for items in _benchmark_slices(benchmark, item_id, item_text, min_tokens, min_item_tokens, benchmark_bytes):

        def clean(texts, items=items):
            t = tk.tokenize(texts)
            stay = np.ones(len(texts), bool)
            stay[shard_matches(t.hash, t.doc, items)[0]] = False
            return stay

        out = keep_rows(out, text, clean, SHARD_BYTES)
    return out
