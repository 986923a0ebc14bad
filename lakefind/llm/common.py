"""What the operators of this subpackage share: tables in the shared folder,
size-checked joins, unclashing column names and bounded Arrow slices."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import as_strings

#: A table is broadcast only if its Parquet files are no larger than this; beyond it a shuffled join does the same.
BROADCAST_BYTES = 16 << 20


def fresh(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    return next(n for n in itertools.chain([base], (f"{base}_{i}" for i in itertools.count())) if n.lower() not in taken)


def col(df: DataFrame, name: str):
    """A column by its exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset and Spark runs in one process (tests), a temporary folder
    is made and set; on a cluster it has to be set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lakefind-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def drop_written(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`written`."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and spark.sparkContext._gateway is not None:
        try:
            drop_written(spark, path)
        except Exception:  # the session may be gone; its shared folder goes with it
            pass


def written(df: DataFrame, keep: bool = True) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back; its lineage ends there.

    The files stay until the process ends, since the result may be read at any
    time; with keep=False the caller deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakefind-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if keep:
        atexit.register(_drop_at_exit, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a written table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def small_enough(table: DataFrame, path: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The written table with a broadcast hint if its files are at most limit bytes, else as it is."""
    return F.broadcast(table) if size_of(table.sparkSession, path) <= limit else table


#: A group with more than 1/HOT of all rows is hot; there are fewer than HOT of them, whatever the data.
HOT = 1000


def attach_by_group(rows: DataFrame, group: str, table: DataFrame, path: str, key: str, totals: DataFrame, total: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows left-joined with a written table that has at most one row a group.

    A small table is broadcast.  Beyond that both sides are shuffled by group and
    salt: a hot group's rows spread over as many salts as it has thousandths of
    all rows, and its row of the table is repeated for each.  totals has the rows
    of each group (columns key and total); only its hot groups are broadcast.
    """
    if size_of(rows.sparkSession, path) <= limit:
        return rows.join(F.broadcast(table), col(rows, group) == col(table, key), "left")
    every = totals.agg(F.sum(total)).first()[0] or 0
    salts = F.ceil(F.col(total) * HOT / F.lit(max(1, every))).cast("int")
    hot = totals.select(F.col(key).alias("lf_hot"), salts.alias("lf_salts")).where(F.col("lf_salts") > 1)
    names = [fresh(x, rows, table) for x in ("lf_hot", "lf_salts", "lf_salt", "lf_other")]
    hot = hot.toDF(*names[:2])
    by = table.join(F.broadcast(hot), col(table, key) == F.col(names[0]), "left")
    by = by.withColumn(names[3], F.explode(F.sequence(F.lit(0), F.coalesce(F.col(names[1]), F.lit(1)) - 1))).select(*[col(by, c) for c in table.columns], names[3])
    left = rows.join(F.broadcast(hot), col(rows, group) == F.col(names[0]), "left")
    # by the row's own values: a task that is run again sends its rows to the same places
    values = [col(left, f.name) for f in rows.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]
    salt = F.when(F.col(names[1]) > 1, F.pmod(F.xxhash64(*values), F.col(names[1]))).otherwise(0).cast("int")
    left = left.withColumn(names[2], salt).select(*[col(left, c) for c in rows.columns], names[2])
    joined = left.join(by.hint("merge"), (col(left, group) == col(by, key)) & (F.col(names[2]) == F.col(names[3])), "left")
    return joined.select(*[col(joined, c) for c in (*rows.columns, *table.columns)])


#: Bytes of a batch of rows that goes to Python; Spark's own bound is eight times as much.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session's batches for Python have at most BATCH_BYTES, so long texts do not add up in memory."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(name, None) or "").rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice's texts have at most max_bytes, or a slice has one row."""
    for b in batches:
        if not b.num_rows:
            continue
        a = as_strings(b.column(b.schema.get_field_index(text)))
        off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
        i, n = 0, len(a)
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
            j = min(j, n)
            yield b.slice(i, j - i)
            i = j


def keep_rows(docs: DataFrame, text: str, decide, max_bytes: int) -> DataFrame:
    """The rows for which decide(texts of a slice) is true; columns as they were, whatever their names."""
    at = docs.columns.index(text)
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema.fields)])

    def run(batches):
        for b in slices(batches, names[at], max_bytes):
            yield b.filter(pa.array(decide(b.column(at)), pa.bool_()))

    return bounded_batches(docs).toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def expand_ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, x) with lo[i] <= x < hi[i]."""
    n = np.maximum(hi - lo, 0)
    who = np.repeat(np.arange(len(n)), n)
    if not len(who):
        return who, who
    first = np.repeat(np.cumsum(n) - n, n)
    return who, np.arange(len(who)) - first + lo[who]


def ranked(a) -> np.ndarray:
    """Numbers in the order of an Arrow array's values; equal values have equal numbers."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    d = a.dictionary_encode()
    order = pc.sort_indices(d.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[d.indices.to_numpy()]
