"""Upsert and delete by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import quoted


def last_wins(batch: DataFrame, *, id: str = "_id", seq: str) -> DataFrame:
    """One row an id, the one with the greatest seq.

    The greatest row is found by a hash aggregation with a map-side combine, so
    a hot id does not collect its versions in one sort.
    """
    rest = [c for c in batch.columns if c not in (id, seq)]
    row = F.struct(F.col(quoted(seq)), *[F.col(quoted(c)) for c in rest])
    best = batch.groupBy(quoted(id)).agg(F.max_by(row, F.col(quoted(seq))).alias("__lf_row"))
    return best.select(F.col(quoted(id)), *[F.col("__lf_row")[c].alias(c) for c in batch.columns if c != id])


def delete(base: DataFrame, ids: DataFrame, *, id: str = "_id") -> DataFrame:
    """The rows whose id is not among the ids."""
    gone = ids.select(F.col(quoted(id)).alias("__lf_gone"))
    return base.join(gone, F.col(quoted(id)) == F.col("__lf_gone"), "left_anti")


def upsert(base: DataFrame, batch: DataFrame, *, id: str = "_id", seq: str | None = None) -> DataFrame:
    """Base with the batch's rows in place of those with the same id; with seq the last of the batch wins."""
    new = last_wins(batch, id=id, seq=seq).drop(seq) if seq else batch
    return delete(base, new, id=id).unionByName(new, allowMissingColumns=True)
