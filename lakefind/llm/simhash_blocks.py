"""Near-duplicate groups by SimHash with pigeonhole blocks.

A fingerprint is 64 bits, cut into ``blocks`` blocks.  Two fingerprints within
``distance`` bits differ in at most that many blocks, so they agree in at least
``blocks - distance`` of them: for some choice of that many blocks both have the
same key.  Fingerprints are joined on every such choice, the Hamming distance
is verified, and connected pairs form groups.  The search is exact.

Scale: texts are read once and only (id, fingerprint) goes on.  Equal
fingerprints are one node, so thousands of exact copies cost one row in the
join.  A pair that agrees in more blocks than needed is emitted by the first
matching choice alone, so no distinct is needed.  Groups are found by
alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014), each written to the shared folder.

Defined results
---------------
* The fingerprint is over the distinct tokens of the whole text.  A token's vote
  on a bit has a sign and a heavy-tailed weight, both hashes of token and bit (a
  sign stable projection: Li, Samorodnitsky and Hopcroft, 2013).  A few votes
  decide each bit, others each time, so that few edits change it.  Null texts and
  texts without tokens have none and belong to no group; rows with a null
  doc_id cannot be named and belong to none either.  Both are kept.
* doc_id is the key of a document: rows that repeat one are copies of the same
  document, of which the first by text stays.  The group's document that stays
  is the one with the smallest doc_id.
* An empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as tk
from .common import attach_by_group, bounded_batches, col, column_of, drop_written, fresh, slices, small_enough, written

_PIECE = 2 << 20


def _votes(tail: float = 0.8, bits: int = 16) -> np.ndarray:
    """Signed weights by hash value, Pareto with the given tail; whole numbers, so that sums do not depend on order."""
    half = 1 << (bits - 1)
    weight = np.rint(16 * ((np.arange(half) + 0.5) / half) ** (-1 / tail)).astype(np.int64)
    return np.concatenate([weight, -weight])


_VOTES = _votes()


def fingerprints(col) -> tuple[np.ndarray, np.ndarray]:
    """64-bit SimHash of each text over its distinct tokens, and whether it has any.

    Bit i is set if the sum of the tokens' votes on it is positive.
    """
    t = tk.tokenize(col)
    n = len(t.doc) - 1
    out = np.zeros(n, np.uint64)
    # one sort finds the distinct (text, word) pairs: text number above, 40 bits of the word's hash below
    key = (t.owners().astype(np.uint64) << np.uint64(40)) | (t.hash >> np.uint64(24))
    key.sort()
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    owner = (key >> np.uint64(40)).astype(np.int64)
    word = tk.mix(key & np.uint64((1 << 40) - 1))
    counts = np.bincount(owner, minlength=n)
    has = counts > 0
    if has.any():
        first = np.cumsum(counts[has]) - counts[has]
        f = np.zeros(len(first), np.uint64)
        for i in range(0, 64, 4):
            # a hash has the votes on four bits
            word = tk.mix(word)
            for k in range(4):
                place = ((word >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.intp)
                f |= (np.add.reduceat(_VOTES[place], first) > 0).astype(np.uint64) << np.uint64(i + k)
        out[has] = f
    return out, has


def fingerprint_table(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """Columns d (doc_id) and f (fingerprint as bigint) of the documents that have one."""
    schema = T.StructType([T.StructField("d", docs.schema[doc_id].dataType), T.StructField("f", T.LongType())])

    def run(batches):
        for b in slices(batches, "t", _PIECE):
            f, has = fingerprints(column_of(b, "t"))
            yield pa.RecordBatch.from_arrays([column_of(b, "d"), pa.array(f.view(np.int64))], names=["d", "f"]).filter(pa.array(has))

    narrow = bounded_batches(docs).select(col(docs, doc_id).alias("d"), col(docs, text).alias("t"))
    return narrow.where(F.col("d").isNotNull() & F.col("t").isNotNull()).mapInArrow(run, schema)


def block_masks(blocks: int) -> list[int]:
    """Bit masks of the fingerprint's blocks, sizes as even as can be."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def similar_fingerprints(nodes: DataFrame, *, distance: int, blocks: int) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in column f within the distance."""
    masks = block_masks(blocks)
    choices = list(combinations(range(blocks), blocks - distance))
    keys = F.array(*[F.col("f").bitwiseAND(F.lit(_signed(sum(masks[i] for i in c)))) for c in choices])
    rows = nodes.select("f", F.posexplode(keys).alias("c", "k"))
    # the blocks of each choice as a bit set, and all blocks up to its last one
    chosen = F.array(*[F.lit(sum(1 << i for i in c)) for c in choices])
    upto = F.array(*[F.lit((2 << c[-1]) - 1) for c in choices])
    x = F.col("l.f").bitwiseXOR(F.col("r.f"))
    equal = sum((F.when(x.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(masks)), F.lit(0))
    first = equal.bitwiseAND(F.element_at(upto, F.col("l.c") + 1)) == F.element_at(chosen, F.col("l.c") + 1)
    near = F.bit_count(x) <= distance
    on = (F.col("l.k") == F.col("r.k")) & (F.col("l.c") == F.col("r.c")) & (F.col("l.f") < F.col("r.f"))
    # the keys are many times the fingerprints, which Spark's size estimates leave out: never broadcast them
    return rows.alias("l").join(rows.alias("r").hint("merge"), on & near & first).select(F.col("l.f").alias("a"), F.col("r.f").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """The smallest node connected with each node of an edge: columns u, root (u != root).

    edges: columns a, b.  Each round is written to the shared folder, so a round
    never depends on what an executor holds.
    """
    spark = edges.sparkSession

    def minima(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")

    now, path = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")), keep=False)
    while True:
        sides = both(now)
        large = sides.join(minima(sides), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        mins = minima(large)
        small = large.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        after, after_path = written(small, keep=False)
        # a fixed point: every node has one neighbour, and no root has a parent of its own
        bad = after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("u").unionByName(after.select(F.col("v").alias("u")).join(after.select("u"), "u", "left_semi")).limit(1).count()
        drop_written(spark, path)
        now, path = after, after_path
        if not bad:
            out, _ = written(now.select("u", F.col("v").alias("root")))
            drop_written(spark, path)
            return out


def duplicates(docs: DataFrame, *, doc_id="doc_id", text="text", distance: int = 8, blocks: int = 11) -> DataFrame:
    """doc_id and duplicate_of, the smallest doc_id of its group, of every document but the groups' first ones."""
    prints, _ = written(fingerprint_table(docs, doc_id=doc_id, text=text))
    firsts, _ = written(prints.groupBy("f").agg(F.min("d").alias("first"), F.count_distinct("d").alias("n")))
    roots = components(similar_fingerprints(firsts.select("f"), distance=distance, blocks=blocks))
    # the group of every fingerprint, then the smallest document of every group
    group = firsts.join(roots.withColumnRenamed("u", "f"), "f", "left").select("f", "first", "n", F.coalesce("root", "f").alias("g"))
    best = group.groupBy("g").agg(F.min("first").alias("duplicate_of"), F.sum("n").alias("size")).where(F.col("size") > 1)
    keep = group.join(best, "g").select(F.col("f").alias("kf"), "duplicate_of")
    table, path = written(keep)
    # a fingerprint that very many documents have is a hot key
    copies = firsts.select(F.col("f").alias("kf"), "n")
    return attach_by_group(prints, "f", table, path, "kf", copies, "n").where(F.col("d") != F.col("duplicate_of")).select(F.col("d").alias("doc_id"), "duplicate_of").distinct()


def drop_duplicates(docs: DataFrame, *, doc_id="doc_id", text="text", distance: int = 8, blocks: int = 11) -> DataFrame:
    """The documents with one of each near-duplicate group; columns as they were."""
    key = fresh("lf_gone", docs)
    gone, path = written(duplicates(docs, doc_id=doc_id, text=text, distance=distance, blocks=blocks).select(F.col("doc_id").alias(key)))
    out = docs.join(small_enough(gone, path), col(docs, doc_id) == F.col(key), "left_anti")
    # rows that repeat a doc_id are seldom: they alone are ordered by text
    again = docs.select(col(docs, doc_id).alias(key)).where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(key)
    again, path = written(again)
    if again.isEmpty():
        return out
    table = small_enough(again, path)
    rank = fresh("lf_rank", docs)
    repeated = out.join(table, col(out, doc_id) == F.col(key), "left_semi")
    others = [col(repeated, c).cast("string") for c in docs.columns if c not in (doc_id, text)]
    first = repeated.withColumn(rank, F.row_number().over(Window.partitionBy(col(repeated, doc_id)).orderBy(col(repeated, text).asc_nulls_last(), *others))).where(F.col(rank) == 1).drop(rank)
    return out.join(table, col(out, doc_id) == F.col(key), "left_anti").unionByName(first)
