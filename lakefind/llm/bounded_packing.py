"""Packing documents into training windows with bounded space.

Each partition packs its documents online with a fixed number of open windows:
a piece goes into the open window with the least room that still holds it (best
fit); if none does, the fullest open window is emitted and a new one opened.
What the partitions leave open is merged at the end by the same rule.

Only (doc_id, length) is shuffled, never a text.  The partition of a document
depends on its doc_id and length alone and each partition is packed in doc_id
order, so a task that is run again packs the same windows.  Rows that repeat both
are counted first, and spread over partitions by the thousand.  A task holds ``open_windows``
windows, whatever the corpus.  A partition leaves at most that many over; they are
merged ``merge_fan_in`` partitions at a time, what these leave over again, until
one group remains, so no task gets more as the corpus grows.

Defined results
---------------
* A document longer than a window is cut into full windows and a rest; a piece
  is (doc_id, start, length) in tokens.
* Null and empty texts have no tokens and are in no window.
* Null doc_ids are packed like others, after a partition's other documents;
  repeated rows are packed each.  Ties go to the window opened first.
* An empty table gives no windows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens as tk
from .common import bounded_batches, col, column_of, slices, written

_PIECE = 4 << 20
#: Rows with one doc_id and length that stay together.
COPIES = 1000


class OpenWindows:
    """A fixed number of open windows with best fit; emits the fullest when none fits."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.used: list[int] = []
        self.held: list[list] = []

    def place(self, size: int, pieces: list) -> Iterator[tuple[int, list]]:
        """Put pieces of a total size into a window; yields the window that had to be emitted, if any."""
        best, room = -1, self.capacity + 1
        for i, u in enumerate(self.used):
            left = self.capacity - u
            if size <= left < room:
                best, room = i, left
        if best >= 0:
            self.used[best] += size
            self.held[best].extend(pieces)
            if self.used[best] == self.capacity:
                yield self.close(best)
            return
        if len(self.used) == self.most:
            yield self.close(max(range(self.most), key=lambda i: (self.used[i], -i)))
        self.used.append(size)
        self.held.append(list(pieces))

    def close(self, i: int) -> tuple[int, list]:
        return self.used.pop(i), self.held.pop(i)

    def rest(self) -> Iterator[tuple[int, list]]:
        while self.used:
            yield self.close(0)


def pack(lengths: Iterable[tuple], space: OpenWindows) -> Iterator[tuple[int, list]]:
    """Windows emitted while (doc_id, length) pairs are packed; the open ones stay in space."""
    capacity = space.capacity
    for d, n in lengths:
        at = 0
        while n - at >= capacity:
            yield capacity, [(d, at, capacity)]
            at += capacity
        if n > at:
            yield from space.place(n - at, [(d, at, n - at)])


def token_lengths(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """Columns d (doc_id) and n (number of tokens) of the documents that have any."""
    schema = T.StructType([T.StructField("d", docs.schema[doc_id].dataType), T.StructField("n", T.LongType())])

    def run(batches):
        for b in slices(batches, "t", _PIECE):
            n = tk.token_counts(column_of(b, "t"))
            yield pa.RecordBatch.from_arrays([column_of(b, "d"), pa.array(n)], names=["d", "n"]).filter(pa.array(n > 0))

    return bounded_batches(docs).select(col(docs, doc_id).alias("d"), col(docs, text).alias("t")).mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame,
    *,
    doc_id="doc_id",
    text="text",
    capacity: int = 2048,
    open_windows: int = 16,
    docs_per_partition: int = 20000,
    merge_fan_in: int = 500,
) -> DataFrame:
    """All windows: window_id, n_tokens and pieces, an ordered array of (doc_id, start, length).

    window_id is "<partition>-<number>", with "m<level>-" before it for merged leftovers.
    """
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType
    lengths, _ = written(token_lengths(docs, doc_id=doc_id, text=text))
    parts = max(1, -(-lengths.count() // docs_per_partition))
    piece = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    schema = T.StructType([T.StructField("p", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("left", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("pieces", T.ArrayType(piece))])
    arrow = pa.list_(pa.struct([("doc_id", _arrow_type(id_type)), ("start", pa.int64()), ("length", pa.int64())]))

    def batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.bool_(), pa.int64()))]
            + [pa.array([[{"doc_id": d, "start": s, "length": n} for d, s, n in r[4]] for r in rows], arrow)],
            names=["p", "k", "left", "n_tokens", "pieces"],
        )

    def run(batches):
        state: dict[int, list] = {}

        def finish(p):
            space, k = state.pop(p)
            rows = [(p, k + i, True, n, w) for i, (n, w) in enumerate(space.rest())]
            return [batch(rows)] if rows else []

        for b in batches:
            ps = column_of(b, "p").to_numpy()
            cuts = np.flatnonzero(np.append(True, ps[1:] != ps[:-1])) if len(ps) else []
            for i, lo in enumerate(cuts):
                hi = cuts[i + 1] if i + 1 < len(cuts) else len(ps)
                p = int(ps[lo])
                for other in [x for x in state if x != p]:  # sorted input: that partition has ended
                    yield from finish(other)
                space, k = state.setdefault(p, [OpenWindows(capacity, open_windows), 0])
                part = b.slice(lo, hi - lo)
                rows = []
                for n, w in pack(((d, n) for d, n, m in zip(*(column_of(part, c).to_pylist() for c in "dnm")) for _ in range(m)), space):
                    rows.append((p, k, False, n, w))
                    k += 1
                state[p][1] = k
                if rows:
                    yield batch(rows)
        for p in list(state):
            yield from finish(p)

    same = lengths.groupBy("d", "n").agg(F.count(F.lit(1)).alias("c"))
    same = same.select("d", "n", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / COPIES))).alias("s"))
    placed = same.select("d", "n", F.least(F.lit(COPIES).cast("long"), F.col("c") - F.col("s") * COPIES).alias("m"), F.pmod(F.xxhash64("d", "n", "s"), F.lit(parts)).cast("int").alias("p"))
    placed = placed.repartition(parts, "p").sortWithinPartitions("p", F.col("d").asc_nulls_last(), "n", "m")
    packed, _ = written(placed.mapInArrow(run, schema))

    def together(batches):
        """The leftovers of each group of partitions, largest first, by the same rule."""
        space, group, k = None, None, 0

        def rest():
            return [(group, k + i, True, n, w) for i, (n, w) in enumerate(space.rest())]

        for b in batches:
            rows = []
            for r in b.to_pylist():
                if space is None or r["g"] != group:
                    if space is not None:
                        rows += rest()
                    space, group, k = OpenWindows(capacity, open_windows), r["g"], 0
                for n, w in space.place(r["n_tokens"], [(x["doc_id"], x["start"], x["length"]) for x in r["pieces"]]):
                    rows.append((group, k, False, n, w))
                    k += 1
            if rows:
                yield batch(rows)
        if space is not None:
            yield batch(rest())

    done = packed.where("not left").select(F.concat_ws("-", "p", "k").alias("window_id"), "n_tokens", "pieces")
    level = 0
    while True:
        level += 1
        groups = -(-parts // merge_fan_in)
        left = packed.where("left").withColumn("g", F.floor(F.col("p") / merge_fan_in).cast("int"))
        left = left.repartition(groups, "g").sortWithinPartitions("g", F.desc("n_tokens"), "p", "k").select("g", "n_tokens", "pieces")
        merged = left.mapInArrow(together, schema)
        name = F.concat_ws("-", F.lit(f"m{level}"), "p", "k").alias("window_id")
        if groups == 1:
            return done.unionByName(merged.select(name, "n_tokens", "pieces"))
        packed, _ = written(merged)
        done = done.unionByName(packed.where("not left").select(name, "n_tokens", "pieces"))
        parts = groups


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)
