"""Duplicate substrings by relative Lempel-Ziv parsing against indexed blocks.

A document is factored greedily against reference blocks that a suffix array
indexes: the longest factor at a position is found through its neighbours in the
suffix array, the parse jumps to the factor's end, and it is checked at the
boundary: each of the factor's last ``min_tokens - 1`` tokens may begin a factor
that goes on beyond it, so the parse goes on from there.  Factors of at least
``min_tokens`` tokens of documents with a smaller doc_id are duplicate spans.
Thus a span has just the tokens that lie in a run of that length which also
occurs in a document with a smaller doc_id.

Parsing every document against every block of the corpus is quadratic: the
corpus is read once a block.  Which blocks can give a factor is therefore found
first, without losing one:

1. Winnowing (Schleimer, Wilkerson and Aiken, 2003) picks anchor positions by
   content: any run of ``min_tokens`` tokens holds an anchor, and equal runs hold
   the same one.  A factor of that length can therefore only come from a place
   with the same anchor, within the anchor's segment (the tokens so near that a
   run of ``min_tokens`` can hold both).
2. Anchors, not texts, are counted, with partial aggregation before the shuffle.
   Those of one document fall away.  Places whose whole segments are equal are
   duplicates of the first one; a passage in thousands of documents is settled
   here, by two hashes of 64 bits, in linear time.
3. Of each different segment of an anchor, one goes into a reference block.  A
   block holds all segments of its anchors; each is parsed against those of
   smaller doc_ids, and what is found holds for all places of the segment.
4. An anchor with more than ``max_segments`` different segments (a phrase that
   stands in very many surroundings) would make a block too large for a task.
   Its segments' runs of ``min_tokens`` tokens are counted by hash instead, also
   with partial aggregation, which finds the same spans.

Defined results
---------------
* Places are token numbers from 0, the end exclusive.  Spans that touch or
  overlap are one; first_doc_id is the smallest doc_id that has any of its runs.
* Repeats inside one document are not duplicates; neither are documents shorter
  than ``min_tokens``, null or empty texts.
* Rows with a null doc_id cannot be named or ordered and are left out.  Rows that
  repeat a doc_id are one document, also where their texts differ: a span of any
  of them is reported, once.
* An empty table gives no spans; other columns are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as tk
from .common import bounded_batches, col, column_of, expand_ranges, fresh, ranked, slices, written
from .suffix_decontamination import suffix_array

_PIECE = 2 << 20
#: Tokens in an anchor.
ANCHOR = 16
#: Tokens of a reference block; an anchor's segments always stay together.
BLOCK_TOKENS = 1 << 19
#: Different segments of an anchor that go into one block.
MAX_SEGMENTS = 1 << 13


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i:i+width] for every i; the result is width - 1 shorter."""
    have = 1
    while have * 2 <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    extra = width - have
    return op(x[: len(x) - extra], x[extra:]) if extra else x


def anchors(t: tk.Tokens, min_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed anchors of a batch: token positions in the batch and their gram hashes."""
    k = min(ANCHOR, min_tokens)
    width = min_tokens - k + 1
    g = tk.gram_hash(t.hash, k)
    if len(g) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = _sliding(g, width, np.minimum)
    # windows that leave their document do not count
    end = np.repeat(t.doc[1:], t.counts)[: len(low)]
    low[np.arange(len(low)) + min_tokens > end] = 0
    # a gram is an anchor if it is the least of a window it is in: if the greatest of those minima equals it
    pad = np.zeros(width - 1, np.uint64)
    top = _sliding(np.concatenate([pad, low, pad]), width, np.maximum)
    at = np.flatnonzero((g == top) & (top > 0))
    return at, g[at]


def _anchor_rows(docs: DataFrame, id_type, min_tokens: int) -> DataFrame:
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("s", T.LongType()), T.StructField("d", id_type), T.StructField("p", T.IntegerType()), T.StructField("e", T.IntegerType())])
    before = min_tokens - min(ANCHOR, min_tokens)

    def run(batches):
        for b in slices(batches, "t", _PIECE):
            t = tk.tokenize(column_of(b, "t"))
            at, g = anchors(t, min_tokens)
            own = np.searchsorted(t.doc, at, "right") - 1
            lo = np.maximum(at - before, t.doc[own])
            hi = np.minimum(at + min_tokens, t.doc[own + 1])
            seg = tk.range_hash(tk.prefix_hash(t.hash), lo, hi) ^ tk.mix((at - lo).astype(np.uint64))
            first = t.doc[own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(g.view(np.int64)), pa.array(seg.view(np.int64)), column_of(b, "d").take(pa.array(own)), pa.array(at - first, pa.int32()), pa.array(hi - first, pa.int32())],
                names=["a", "s", "d", "p", "e"],
            )

    return docs.mapInArrow(run, schema)


def _common(ids: np.ndarray, a: np.ndarray, b: np.ndarray, width: int = 32) -> np.ndarray:
    """How many tokens from places a and from places b are the same; ids goes on for width after its end."""
    out = np.zeros(len(a), np.int64)
    ahead = np.arange(width)
    for at in range(0, len(a), 1 << 15):
        act = np.arange(at, min(at + (1 << 15), len(a)))
        while len(act):  # every segment ends with a mark of its own, so no match runs on beyond it
            same = ids[(a[act] + out[act])[:, None] + ahead] == ids[(b[act] + out[act])[:, None] + ahead]
            whole = same.all(axis=1)
            out[act] += np.where(whole, width, np.argmin(same, axis=1))
            act = act[whole]
    return out


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Of each power of two, the least of so many values from every place on."""
    out = [values]
    while 2 << (len(out) - 1) <= len(values):
        last, half = out[-1], 1 << (len(out) - 1)
        out.append(np.minimum(last[:-half], last[half:]))
    return out


def _smaller(minima: list[np.ndarray], at: np.ndarray, than: np.ndarray, step: int) -> np.ndarray:
    """The nearest place before (step -1) or after (1) each place whose value is less; one outside the array if there is none."""
    n = len(minima[0])
    at = at + (step > 0)
    for level in range(len(minima) - 1, -1, -1):
        width, least = 1 << level, minima[level]
        lo = at if step > 0 else at - width
        inside = (lo >= 0) & (lo + width <= n)
        skip = inside & (least[np.clip(lo, 0, len(least) - 1)] >= than)
        at = at + np.where(skip, step * width, 0)
    return at if step > 0 else at - 1


def _longest(ids: np.ndarray, sa: np.ndarray, rank: np.ndarray, minima: list[np.ndarray], doc: np.ndarray, group: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Length of the longest factor at each position p that a smaller document has.

    Suffixes are sorted, so it is shared with the nearest suffix of a smaller
    document above or below, if that begins with the same run.
    """
    best = np.zeros(len(p), np.int64)
    for step in (-1, 1):
        at = _smaller(minima, rank[p], doc[p], step)
        w = np.flatnonzero((at >= 0) & (at < len(sa)))
        w = w[group[at[w]] == group[rank[p[w]]]]
        best[w] = np.maximum(best[w], _common(ids, p[w], sa[at[w]]))
    return best


def parse_block(tokens: np.ndarray, sizes: np.ndarray, docs: np.ndarray, min_tokens: int) -> tuple[np.ndarray, ...]:
    """Greedy factors of at least min_tokens tokens of each segment in the segments of smaller documents.

    tokens has the segments one after the other, docs each segment's rank by
    doc_id.  Arrays (segment, start, end, rank of the smallest document that has
    a run of the factor).
    """
    none = (np.zeros(0, np.int64),) * 4
    k = len(sizes)
    n = int(sizes.sum()) + k
    first = np.cumsum(sizes + 1) - sizes - 1
    own = np.repeat(np.arange(k), sizes + 1)
    words, inv = np.unique(tokens, return_inverse=True)
    ids = np.empty(n, np.int64)
    mark = np.zeros(n, bool)
    mark[first + sizes] = True
    ids[mark] = np.arange(k)
    ids[~mark] = inv + k
    sa = suffix_array(ids)
    # suffixes that begin with the same run are neighbours in the suffix array; others begin no factor
    run = tk.gram_hash(ids.view(np.uint64), min_tokens)
    whole = np.zeros(n, bool)
    whole[: len(run)] = np.arange(len(run)) + min_tokens <= first[own[: len(run)]] + sizes[own[: len(run)]]
    sa = sa[whole[sa]]
    if not len(sa):
        return none
    doc = docs[own]
    key = run[sa]
    new = np.append(True, key[1:] != key[:-1])
    group = np.cumsum(new)
    rank = np.full(n, -1, np.int64)
    rank[sa] = np.arange(len(sa))
    cut = np.flatnonzero(new)
    least = np.full(n, len(docs), np.int64)
    least[sa] = np.repeat(np.minimum.reduceat(doc[sa], cut), np.diff(np.append(cut, len(sa))))
    hit = np.flatnonzero(least < doc)
    if not len(hit):
        return none
    # the parse: all segments at once, each at its own place
    padded = np.append(ids, np.full(32, -1)).astype(np.int32)
    minima = _minima(doc[sa].astype(np.int32))
    seg = np.unique(own[hit])
    at = first[seg].copy()
    out: list[tuple[np.ndarray, ...]] = []
    while len(seg):
        j = np.searchsorted(hit, at)
        ok = j < len(hit)
        seg, p = seg[ok], hit[np.minimum(j[ok], len(hit) - 1)]
        ok = own[p] == seg
        seg, p = seg[ok], p[ok]
        if not len(seg):
            break
        length = _longest(padded, sa, rank, minima, doc, group, p)
        good = length >= min_tokens  # a run that only its hash has in common is none
        out.append((seg[good], p[good], length[good]))
        at = p + np.where(good, length - min_tokens + 1, 1)
    s, p, length = (np.concatenate(x) for x in zip(*out))
    if not len(s):
        return none
    who, q = expand_ranges(p, p + length - min_tokens + 1)
    r = np.minimum.reduceat(least[q], np.flatnonzero(np.append(True, who[1:] != who[:-1])))
    return s, p - first[s], p - first[s] + length, r


def _blocks(batches, size: int):
    """Rows in tables of at least size tokens; an anchor's rows are in one table, and rows come in order of anchors."""
    held: list[pa.RecordBatch] = []
    tokens = 0
    for b in batches:
        if not b.num_rows:
            continue
        a = column_of(b, "a").to_numpy()
        n = np.cumsum(pc.binary_length(column_of(b, "w")).to_numpy(zero_copy_only=False)) // 8
        last = column_of(held[-1], "a")[-1].as_py() if held else None
        starts = np.flatnonzero(np.append(a[0] != last, a[1:] != a[:-1]))
        lo = 0
        for x in starts:
            if tokens + (n[x - 1] if x else 0) - (n[lo - 1] if lo else 0) >= size and (held or x > lo):
                yield pa.Table.from_batches([*held, b.slice(lo, x - lo)])
                held, tokens, lo = [], 0, int(x)
        held.append(b.slice(lo))
        tokens += int(n[-1] - (n[lo - 1] if lo else 0))
    if held:
        yield pa.Table.from_batches(held)


def _hashes(w: pa.Array) -> np.ndarray:
    """The token hashes in a column of raw bytes, row after row."""
    if isinstance(w, pa.ChunkedArray):
        w = w.combine_chunks()
    return np.frombuffer(b"".join(w.to_pylist()), np.uint64)


def duplicate_spans(docs: DataFrame, *, doc_id="doc_id", text="text", min_tokens: int = 50, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """Duplicate spans: doc_id, start_token, end_token, first_doc_id."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema[doc_id].dataType
    arrow_id = to_arrow_type(id_type)
    before = min_tokens - min(ANCHOR, min_tokens)
    narrow = bounded_batches(docs).select(col(docs, doc_id).alias("d"), col(docs, text).alias("t")).where(F.col("d").isNotNull() & F.col("t").isNotNull())
    places, _ = written(_anchor_rows(narrow, id_type, min_tokens))

    # the different segments of anchors that two documents have, each with its first place
    segments = places.groupBy("a", "s").agg(F.min(F.struct("d", "p", "e")).alias("first"), F.max("d").alias("last"))
    several = segments.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.min("first.d").alias("lo"), F.max("last").alias("hi")).where(F.col("lo") < F.col("hi"))
    live = segments.join(several.select(F.col("a").alias("ka"), "k").hint("merge"), F.col("a") == F.col("ka")).where((F.col("k") > 1) | (F.col("last") > F.col("first.d")))
    live, _ = written(live.select("a", "s", "first.d", "first.p", "first.e", "last", "k"))

    # what holds at every place p of a segment: the tokens p + x to p + y are a duplicate of r
    offset = F.least(F.col("p"), F.lit(before))
    equal = live.where(F.col("last") > F.col("d")).select("a", "s", (-offset).cast("int").alias("x"), (F.col("e") - F.col("p")).cast("int").alias("y"), F.col("d").alias("r"))

    picks = live.where(F.col("k") > 1).groupBy("d").agg(F.collect_list(F.struct("a", "s", "p", "e", (F.col("k") > max_segments).alias("big"))).alias("at"))
    key = fresh("k", narrow)
    # picks grow with the texts: the same shuffled join at every size
    chosen = narrow.join(picks.withColumnRenamed("d", key).hint("merge"), F.col("d") == F.col(key)).select("d", "t", "at")
    cut_type = T.StructType([T.StructField("a", T.LongType()), T.StructField("s", T.LongType()), T.StructField("d", id_type), T.StructField("o", T.IntegerType()), T.StructField("big", T.BooleanType()), T.StructField("w", T.BinaryType())])

    def cut(batches):
        for b in slices(batches, "t", _PIECE):
            t = tk.tokenize(column_of(b, "t"))
            lists = column_of(b, "at")
            own = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            a, s, p, e, big = (flat.field(i) for i in range(5))
            p, e = p.to_numpy(), e.to_numpy()
            lo = np.maximum(p - before, 0)
            first = t.doc[own]
            # another text under the same doc_id may be too short, or have other tokens there
            fits = e <= t.counts[own]
            end = np.where(fits, e, lo)
            seg = tk.range_hash(tk.prefix_hash(t.hash), first + lo, first + end) ^ tk.mix((p - lo).astype(np.uint64))
            fits &= seg.view(np.int64) == s.to_numpy()
            raw = [t.hash[f + x : f + y].tobytes() for f, x, y in zip(first, lo, end)]
            out = pa.RecordBatch.from_arrays([a, s, column_of(b, "d").take(pa.array(own)), pa.array(p - lo, pa.int32()), big, pa.array(raw, pa.binary())], names=cut_type.names)
            yield out.filter(pa.array(fits))

    rule = T.StructType([T.StructField("a", T.LongType()), T.StructField("s", T.LongType()), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("r", id_type)])

    def parse(batches):
        for block in _blocks(batches, BLOCK_TOKENS):
            sizes = pc.binary_length(block["w"]).to_numpy() // 8
            doc = ranked(block["d"])
            s, x, y, r = parse_block(_hashes(block["w"]), sizes.astype(np.int64), doc, min_tokens)
            if not len(s):
                continue
            o = block["o"].to_numpy()[s]
            holder = np.zeros(doc.max() + 1, np.int64)
            holder[doc] = np.arange(len(doc))
            yield pa.RecordBatch.from_arrays(
                [block["a"].combine_chunks().take(pa.array(s)), block["s"].combine_chunks().take(pa.array(s)), pa.array(x - o, pa.int32()), pa.array(y - o, pa.int32()), block["d"].combine_chunks().take(pa.array(holder[r])).cast(arrow_id)], names=rule.names
            )

    rules = equal
    crowded = not live.where(F.col("k") > max_segments).isEmpty()
    cuts = chosen.mapInArrow(cut, cut_type)
    if crowded:
        cuts, _ = written(cuts)
    rules = rules.unionByName(cuts.where("not big").repartition("a").sortWithinPartitions("a").mapInArrow(parse, rule))
    if crowded:
        grams_type = T.StructType([*rule.fields[:3], T.StructField("d", id_type), T.StructField("h", T.LongType())])

        def runs(batches):
            for b in batches:
                sizes = pc.binary_length(column_of(b, "w")).to_numpy(zero_copy_only=False) // 8
                tokens, start = _hashes(column_of(b, "w")), np.cumsum(sizes) - sizes
                who, q = expand_ranges(start, start + sizes - min_tokens + 1)
                h = tk.gram_hash(tokens, min_tokens)
                o = column_of(b, "o").to_numpy()
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays([column_of(b, "a").take(take), column_of(b, "s").take(take), pa.array(q - start[who] - o[who], pa.int32()), column_of(b, "d").take(take), pa.array(h[q].view(np.int64))], names=grams_type.names)

        grams = cuts.where("big").mapInArrow(runs, grams_type)
        least = grams.groupBy(F.col("h").alias("lh")).agg(F.min("d").alias("r"))
        more = grams.join(least.hint("merge"), F.col("h") == F.col("lh")).where(F.col("r") < F.col("d"))
        rules = rules.unionByName(more.select("a", "s", "x", (F.col("x") + min_tokens).cast("int").alias("y"), "r"))

    ka, ks = F.col("ka"), F.col("ks")
    spans = places.join(rules.withColumnsRenamed({"a": "ka", "s": "ks"}).hint("merge"), (F.col("a") == ka) & (F.col("s") == ks)).where(F.col("r") < F.col("d"))
    spans = spans.select("d", (F.col("p") + F.col("x")).alias("x"), (F.col("p") + F.col("y")).alias("y"), "r")
    order = Window.partitionBy("d").orderBy("x", "y")
    reach = F.max("y").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(reach.isNull() | (F.col("x") > reach), 1).otherwise(0))
    spans = spans.withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("d", "g").agg(F.min("x").alias("start_token"), F.max("y").alias("end_token"), F.min("r").alias("first_doc_id")).select(F.col("d").alias("doc_id"), "start_token", "end_token", "first_doc_id")
