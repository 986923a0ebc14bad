"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments, m about code bits / log2(number of codes); each
segment has a table from its value to the codes that have it.  For a query the
radius grows one segment at a time: after all segments were searched to radius
r - 1 and the first a + 1 of them to r, every code within m * r + a bits has been
seen.  A query ends when its kth verified distance is no larger than that, so
its answer is exact, ties included (Norouzi, Punjani and Fleet, 2012).

Scale: the codes are 8 bytes a row or so.  They are cut into shards that fit a
task.  A task indexes its shard once and streams the queries through it; the k
best of the shards are merged.  Only where there are fewer shards than tasks can
run at once, queries are cut into blocks and a shard is indexed once a block.
With s shards the work is that of s smaller searches, which is what exact search
comes to; nothing is collected and nothing that grows is broadcast.

Defined results
---------------
* Bit i of a code is set if component i is above 0; a null component counts as 0.
* Rows with a null id, a null embedding, or one of another length than most have
  (the longer of lengths that are equally frequent) have no code: they neither
  ask nor are found.
* Queries are the rows with a code whose id passes ``asks``; all, without it.  A
  row is not its own neighbour: rows with the query's id are left out.  Rows that repeat an id are one row, the one with
  the smallest code.
* Neighbours are ordered by distance, then id; with fewer than k others, all are
  returned.  An empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, column_of, expand_ranges, ranked, written

#: Codes of an index shard, and queries that a block has at least.
SHARD_ROWS = 1 << 20
BLOCK_ROWS = 1 << 10
_CHUNK = 256


def binary_codes(rows: DataFrame, *, vec_id="vec_id", embedding="embedding") -> DataFrame:
    """Columns i (id) and c (code bytes) of the rows that have a code."""
    narrow = rows.select(col(rows, vec_id).alias("i"), col(rows, embedding).alias("e")).where(F.col("i").isNotNull() & F.col("e").isNotNull())
    most = narrow.groupBy(F.size("e").alias("n")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("n") > 0).orderBy(F.desc("rows"), F.desc("n")).first()
    size = most["n"] if most else 0
    schema = T.StructType([T.StructField("i", rows.schema[vec_id].dataType), T.StructField("c", T.BinaryType())])

    def run(batches):
        for b in batches:
            e = column_of(b, "e").flatten().to_numpy(zero_copy_only=False).astype(float)
            bits = (np.nan_to_num(e) > 0).reshape(-1, size)
            packed = np.packbits(bits, axis=1)
            if packed.shape[1] % 8:
                packed = np.pad(packed, ((0, 0), (0, 8 - packed.shape[1] % 8)))
            yield pa.RecordBatch.from_arrays([column_of(b, "i"), pa.array([r.tobytes() for r in packed], pa.binary())], names=["i", "c"])

    return narrow.where((F.size("e") == size) & (F.size("e") > 0)).mapInArrow(run, schema)


def _words(c: pa.Array) -> np.ndarray:
    """Code bytes as rows of 64-bit words, first bit of the code highest."""
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
    raw = b"".join(c.to_pylist())
    return np.frombuffer(raw, ">u8").reshape(len(c), -1).astype(np.uint64)


class MultiIndex:
    """The segment tables of a shard's codes."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits = codes, bits
        self.m = max(1, -(-bits // 20), min(bits, round(bits / max(1.0, log2(max(2, len(codes)))))))
        edges = [bits * j // self.m for j in range(self.m + 1)]
        self.spans = list(zip(edges, edges[1:]))
        self.order, self.starts, self.masks = [], [], []
        for lo, hi in self.spans:
            v = segment(codes, lo, hi)
            o = np.argsort(v, kind="stable")
            self.order.append(o)
            self.starts.append(np.searchsorted(v[o], np.arange((1 << (hi - lo)) + 1)))

    def flips(self, width: int, radius: int) -> np.ndarray:
        """All values of width bits with exactly radius bits set."""
        if radius == 0:
            return np.zeros(1, np.int64)
        return np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int):
        """Exact k nearest codes of every query but its own: (query number, code number, distance); own is -1 for none."""
        out = []
        for at in range(0, len(queries), _CHUNK):
            out.append(self._chunk(queries[at : at + _CHUNK], own[at : at + _CHUNK], k, at))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def _chunk(self, queries, own, k, base):
        n = len(queries)
        n_codes = len(self.codes)
        pool = np.zeros(0, np.int64)  # query * codes + code
        dist = np.zeros(0, np.int64)
        act = np.arange(n)
        kth = np.full(n, self.bits + 1, np.int64)
        values = [segment(queries, lo, hi) for lo, hi in self.spans]
        radius = 0
        widest = max(hi - lo for lo, hi in self.spans)
        while len(act):
            for a, (lo, hi) in enumerate(self.spans):
                if radius <= hi - lo and len(act):
                    flips = self.flips(hi - lo, radius)
                    keys = (values[a][act][:, None] ^ flips[None, :]).ravel()
                    who, place = expand_ranges(self.starts[a][keys], self.starts[a][keys + 1])
                    q = act[who // len(flips)]
                    c = self.order[a][place]
                    d = np.zeros(len(q), np.int64)
                    for w in range(queries.shape[1]):
                        d += np.bitwise_count(queries[q, w] ^ self.codes[c, w])
                    near = (d <= kth[q]) & (c != own[q])
                    if near.any():
                        pool = np.concatenate([pool, q[near] * n_codes + c[near]])
                        dist = np.concatenate([dist, d[near]])
                        pool, first = np.unique(pool, return_index=True)
                        dist = dist[first]
                        owner = pool // n_codes
                        o = np.lexsort((dist, owner))
                        rank = np.arange(len(o)) - np.searchsorted(owner[o], owner[o], "left")
                        last = o[rank == k - 1]
                        kth[owner[last]] = dist[last]
                        # codes are numbered in id order, so the order within a distance is final
                        keep = np.sort(o[rank < k])
                        pool, dist = pool[keep], dist[keep]
                covered = self.m * radius + a
                act = act[(kth[act] > covered) & (covered < self.bits)]
            radius += 1
            if radius > widest:
                break
        q, c = pool // n_codes, pool % n_codes
        o = np.lexsort((c, dist, q))
        q, c, dist = q[o], c[o], dist[o]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        top = rank < k
        return q[top] + base, c[top], dist[top]


def segment(codes: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Bits lo..hi of codes given as 64-bit words, as integers."""
    out = np.zeros(len(codes), np.int64)
    for w in range(codes.shape[1]):
        a, b = max(lo, 64 * w), min(hi, 64 * (w + 1))
        if a < b:
            part = (codes[:, w] >> np.uint64(64 * (w + 1) - b)) & np.uint64((1 << (b - a)) - 1)
            out = (out << (b - a)) | part.astype(np.int64)
    return out


def nearest(
    rows: DataFrame,
    *,
    vec_id="vec_id",
    embedding="embedding",
    k: int = 10,
    asks: Callable[[Column], Column] | None = None,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k nearest codes of every query: query_id, neighbour_id, distance, rank from 1."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    id_type = rows.schema[vec_id].dataType
    codes, _ = written(binary_codes(rows, vec_id=vec_id, embedding=embedding).groupBy("i").agg(F.min("c").alias("c")))
    asked = codes if asks is None else codes.where(asks(F.col("i")))
    shape = codes.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("c")).alias("b")).first()
    n, bits = shape["n"], 8 * (shape["b"] or 0)
    shards = max(1, -(-n // shard_rows))
    blocks = max(1, min(-(-2 * spark.sparkContext.defaultParallelism // shards), -(-asked.count() // block_rows)))
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("neighbour_id", id_type), T.StructField("distance", T.IntegerType()), T.StructField("rank", T.IntegerType())])

    def run(batches):
        arrow = to_arrow_schema(schema)
        held: list[pa.RecordBatch] = []
        cell, index, ids = None, None, None
        for b in batches:
            kind, at = column_of(b, "asks").to_numpy(zero_copy_only=False), column_of(b, "cell").to_numpy()
            cuts = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (at[1:] != at[:-1]))) if b.num_rows else []
            for lo, hi in zip(cuts, np.append(cuts[1:], b.num_rows)):
                part = b.slice(lo, hi - lo)
                if at[lo] != cell:
                    cell, index, held = at[lo], None, []
                if not kind[lo]:
                    held.append(part)
                    continue
                if index is None:
                    if not held:
                        continue
                    whole = pa.Table.from_batches(held)
                    whole = whole.take(pa.array(np.argsort(ranked(whole["i"]), kind="stable")))
                    # codes are numbered in the order of their ids
                    index, ids, held = MultiIndex(_words(whole["c"]), bits), whole["i"].combine_chunks(), []
                asking = column_of(part, "i")
                own = pc.fill_null(pc.index_in(asking, value_set=ids), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                q, c, d = index.search(_words(column_of(part, "c")), own, k)
                rank = np.arange(len(q)) - np.searchsorted(q, q, "left") + 1
                yield pa.RecordBatch.from_arrays([asking.take(pa.array(q)), ids.take(pa.array(c)), pa.array(d, pa.int32()), pa.array(rank, pa.int32())], schema=arrow)

    mark = F.xxhash64("i", "c")
    shard, block = F.pmod(mark, F.lit(shards)), F.pmod(F.shiftright(mark, 20), F.lit(blocks))
    spread = lambda n, cell: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell))
    stored = codes.select(F.lit(False).alias("asks"), "i", "c", spread(blocks, lambda x: (shard * blocks + x).cast("int")).alias("cell"))
    asking = asked.select(F.lit(True).alias("asks"), "i", "c", spread(shards, lambda x: (x * blocks + block).cast("int")).alias("cell"))
    cells = stored.unionByName(asking).repartitionById(shards * blocks, "cell").sortWithinPartitions("cell", "asks")
    found = cells.mapInArrow(run, schema)
    if shards > 1:
        best = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found
