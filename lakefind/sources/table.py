"""A versioned table: immutable Parquet files and a log of commits.

Commit v is the file ``log/<v>.json`` with the data files added and removed,
the schema, and metadata.  It is created atomically, so of two writers one gets
:class:`WriterLocked`.  Every ``CHECKPOINT_EVERY`` commits the list of live
files is written as a whole, so a read opens a bounded number of log files.

The order of rows is in the files' paths: ``data/<version>-<id>/part-<n>-...``
for the version that wrote them, with ``o=<numbers>/`` in between where the rows
have an order of their own (files of an ingest) or keep that of the file they
were rewritten from.  :meth:`VersionedTable.in_order` gives it as a column, so
the newest version of a row is known whatever order Spark reads files in.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError, WriterLocked
from .files import Files

CHECKPOINT_EVERY = 20
#: So many ids are looked up by a filter that the scan takes.
FEW_IDS = 500


@dataclass
class Snapshot:
    """The state of a table at a version."""

    version: int
    files: dict[str, int] = field(default_factory=dict)  # path -> rows
    schema: dict | None = None
    meta: dict = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(self.files.values())


@dataclass
class Changes:
    """What happened between two versions: files added, and files removed."""

    since: int
    until: int
    added: list[str]
    removed: list[str]


#: The column that :meth:`VersionedTable.in_order` adds.
SEQ = "__lf_seq"
_VERSION = r"/data/([0-9]+)-[^/]*/"
_ORIGIN = r"/o=([0-9-]+)/[^/]*$"
_PART = r"/part-([0-9]+)-[^/]*$"
_CHUNK = r"[.-]c([0-9]+)\.[^/]*$"


def data_file(name: str) -> str:
    """A data file's path in its table: data/<write>/<file>, or data/<write>/o=<order>/<file>."""
    return "data/" + name.rsplit("/data/", 1)[1]


def segment_of(path: str) -> str:
    """The segment of a data file: the file itself, or the whole write where it was a merge."""
    folder = path.split("/")[1]
    return folder if folder.endswith("m") else path


def _position(path: Column) -> Column:
    """Where a file's rows come: numbers that compare from left to right."""
    number = lambda pattern: F.coalesce(F.regexp_extract(path, pattern, 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    origin = F.regexp_extract(path, _ORIGIN, 1)
    start = F.when(origin == "", F.array(number(_VERSION))).otherwise(F.split(origin, "-").cast("array<bigint>"))
    return F.concat(start, F.array(number(_PART), number(_CHUNK)))


class VersionedTable:
    """A table in a directory of any file system Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = Files(spark, self.path)
        self._last: Snapshot | None = None  # commits never change, so the newest one read is kept

    def _log(self, v: int) -> str:
        return f"log/{v:020d}.json"

    def exists(self) -> bool:
        return any(n.endswith(".json") for n in self.fs.names("log"))

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self.fs.names("log") if n.endswith(".json")]

    def version(self) -> int:
        """The latest version, -1 if there is none."""
        return max(self.versions(), default=-1)

    def snapshot(self, version: int | None = None) -> Snapshot:
        last = self.version()
        if version is None:
            version = last
        if version < 0 or version > last:
            raise TableError(f"table {self.path} has no version {version}")
        if self._last is not None and self._last.version == version:
            return self._last
        base = max((int(n.split(".")[0]) for n in self.fs.names("checkpoints") if int(n.split(".")[0]) <= version), default=-1)
        s = Snapshot(-1)
        if base >= 0:
            x = json.loads(self.fs.read(f"checkpoints/{base:020d}.json"))
            s = Snapshot(base, x["files"], x["schema"], x["meta"])
        for v in range(base + 1, version + 1):
            try:
                x = json.loads(self.fs.read(self._log(v)))
            except Exception as e:
                raise TableError(f"table {self.path}: version {v} cannot be read") from e
            for p in x["remove"]:
                s.files.pop(p, None)
            s.files |= x["add"]
            s.schema, s.meta, s.version = x["schema"] or s.schema, x["meta"], v
        if self._last is None or version > self._last.version:
            self._last = s
        return s

    def meta(self) -> dict:
        return dict(self.snapshot().meta)

    def schema(self, version: int | None = None) -> T.StructType:
        s = self.snapshot(version)
        return T.StructType.fromJson(s.schema) if s.schema else T.StructType()

    def files(self, paths, schema: T.StructType) -> DataFrame:
        """The rows of some data files."""
        paths = list(paths)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows at a version, the latest by default."""
        s = self.snapshot(version)
        return self.files(s.files, T.StructType.fromJson(s.schema) if s.schema else T.StructType())

    def in_order(self, paths, schema: T.StructType) -> DataFrame:
        """The rows of some data files with the column ``__lf_seq``: of two rows, the newer has the greater value."""
        if not (paths := list(paths)):
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(SEQ, T.ArrayType(T.LongType()))]))
        rows = self.files(paths, schema)
        own = F.array(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        return rows.select(*[F.col("`" + n.replace("`", "``") + "`") for n in schema.names], F.concat(_position(F.col("_metadata.file_path")), own).alias(SEQ))

    def write_files(self, df: DataFrame, *, max_rows: int = 0, origin: str | None = None, merged: bool = False) -> dict[str, int]:
        """Write rows as new data files that no version has yet: their paths and row counts.

        origin names a column with the place of each row as numbers joined by
        dashes; it is in the files' paths and not written.  merged makes all the
        files one segment.
        """
        part = f"data/{self.version() + 1:020d}-{uuid.uuid4().hex}{'m' if merged else ''}"
        if origin:
            df = df.withColumnRenamed(origin, "o").sortWithinPartitions("o")
        writer = df.write
        if "_id" in df.columns:
            # a lookup by id then skips the row groups that do not have it
            writer = writer.option("parquet.bloom.filter.enabled#_id", "true")
        if max_rows:
            writer = writer.option("maxRecordsPerFile", max_rows)
        if origin:
            writer = writer.partitionBy("o")
        writer.parquet(f"{self.path}/{part}")
        if not any(not n.startswith(("_", ".")) for n in self.fs.names(part)):
            return {}
        # row counts by file; only footers and file names are read
        files = self.spark.read.schema(df.drop("o").schema if origin else df.schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{part}")
        counts = files.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
        return dict(sorted((data_file(r["f"]), r["n"]) for r in counts))

    def size_of(self, paths) -> int:
        """Bytes of some data files; each folder is listed once."""
        have: dict[str, dict[str, int]] = {}
        total = 0
        for p in paths:
            folder, name = p.rsplit("/", 1)
            if folder not in have:
                have[folder] = self.fs.sizes(folder)
            total += have[folder][name]
        return total

    def merge_files(self, paths, schema: T.StructType, task_bytes: int) -> dict[str, int]:
        """Write the rows of some data files anew, as one segment: its files and their row counts.

        The scan packs whole files and pieces of large ones into tasks of at most
        task_bytes (a row group is never cut), so no task grows with the segment.
        """
        settings = {"maxPartitionBytes": f"{task_bytes}b", "openCostInBytes": "0b", "minPartitionNum": "1"}
        settings = {f"spark.sql.files.{k}": v for k, v in settings.items()}
        before = {k: self.spark.conf.get(k, None) for k in settings}
        try:
            for k, v in settings.items():
                self.spark.conf.set(k, v)
            return self.write_files(self.files(paths, schema), merged=True)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def commit(self, add: dict[str, int], remove=(), *, schema: T.StructType | None = None, meta: dict | None = None, expected: int | None = None) -> int:
        """Make the next version; expected is the version the change was made from."""
        last = self.version() if expected is None else expected
        before = self.snapshot(last) if last >= 0 else Snapshot(-1)
        v = last + 1
        entry = {"version": v, "add": add, "remove": list(remove), "schema": json.loads(schema.json()) if schema is not None else before.schema, "meta": before.meta if meta is None else meta}
        if not self.fs.create(self._log(v), json.dumps(entry)):
            raise WriterLocked(f"table {self.path}: version {v} was committed by another writer")
        if v and v % CHECKPOINT_EVERY == 0:
            s = self.snapshot(v)
            self.fs.create(f"checkpoints/{v:020d}.json", json.dumps({"files": s.files, "schema": s.schema, "meta": s.meta}))
        return v

    def append(self, df: DataFrame, *, max_rows: int = 0, origin: str | None = None) -> int:
        """Add rows; new columns are added to the schema."""
        last = self.version()
        schema = self.schema() if last >= 0 else T.StructType()
        have = {f.name: f for f in schema.fields}
        for f in df.schema.fields:
            if f.name == origin:
                continue
            if f.name not in have:
                schema = schema.add(T.StructField(f.name, f.dataType, True))
            elif have[f.name].dataType != f.dataType:
                df = df.withColumn(f.name, F.col("`" + f.name.replace("`", "``") + "`").cast(have[f.name].dataType))
        return self.commit(self.write_files(df, max_rows=max_rows, origin=origin), schema=schema, expected=last)

    def overwrite(self, df: DataFrame, *, max_rows: int = 0, origin: str | None = None) -> int:
        """Replace all rows and the schema."""
        last = self.version()
        old = self.snapshot(last).files if last >= 0 else {}
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name != origin])
        return self.commit(self.write_files(df, max_rows=max_rows, origin=origin), old, schema=schema, expected=last)

    def delete_where(self, where) -> int:
        """Remove rows; only files with such rows are written again, and what is left keeps its place in the order."""
        s = self.snapshot()
        schema = T.StructType.fromJson(s.schema)
        hit = self._files_with(self.files(s.files, schema).where(where))
        if not hit:
            return s.version
        kept = self.files(hit, schema).where(~F.coalesce(where, F.lit(False)))
        kept = kept.withColumn("__lf_origin", F.array_join(_position(F.col("_metadata.file_path")).cast("array<string>"), "-"))
        return self.commit(self.write_files(kept, origin="__lf_origin"), hit, expected=s.version)

    def _files_with(self, rows: DataFrame) -> list[str]:
        return [data_file(r["f"]) for r in rows.select(F.input_file_name().alias("f")).distinct().collect()]

    def files_with_ids(self, s: Snapshot, ids: DataFrame, id: str) -> list[str]:
        """The files of a snapshot that have one of the ids.

        Few ids go to the scan as a list, so the bloom filters skip the row
        groups that have none of them; for many, the id column is scanned.
        """
        schema = T.StructType.fromJson(s.schema)
        rows = self.files(s.files, schema).select(F.col(f"`{id}`").cast("string").alias("i"), F.input_file_name().alias("f"))
        gone = ids.select(F.col(f"`{id}`").cast("string").alias("g"))
        few = [r["g"] for r in gone.limit(FEW_IDS + 1).collect()]
        if len(few) > FEW_IDS:
            return [data_file(r["f"]) for r in rows.join(gone, F.col("i") == F.col("g"), "left_semi").select("f").distinct().collect()]
        name = "spark.sql.parquet.pushdown.inFilterThreshold"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, str(FEW_IDS))
        try:
            return [data_file(r["f"]) for r in rows.where(F.col("i").isin([x for x in few if x is not None])).select("f").distinct().collect()]
        finally:
            self.spark.conf.set(name, before)

    def changes(self, since: int, until: int | None = None) -> Changes:
        """Files that differ between two versions; since < 0 means everything is new."""
        until = self.version() if until is None else until
        new = self.snapshot(until).files if until >= 0 else {}
        old = self.snapshot(since).files if since >= 0 else {}
        return Changes(since, until, [p for p in new if p not in old], [p for p in old if p not in new])

    def changed_rows(self, since: int, until: int | None = None, *, id: str = "_id", seq: bool = False) -> tuple[DataFrame, DataFrame, Changes]:
        """(added rows, removed ids, the changes); with seq, added rows have their order in ``__lf_seq``.

        Removed ids are those of the removed files, as strings; an id that the
        added rows have again is not taken out of them: apply removals first.
        An added file that cannot be read fails the read; nothing is skipped.
        Where a removed file is gone (see :meth:`vacuum`), its ids cannot be
        known: that is a TableError, and all has to be loaded anew.
        """
        c = self.changes(since, until)
        schema = self.schema(c.until) if c.until >= 0 else T.StructType()
        old = self.schema(since) if since >= 0 else schema
        added = self.in_order(c.added, schema) if seq else self.files(c.added, schema)
        if c.removed and id in old.names:
            if lost := self.missing(c.removed):
                raise TableError(f"table {self.path}: {len(lost)} files of version {since} are gone")
            removed = self.files(c.removed, old).select(F.col(f"`{id}`").cast("string").alias(id)).where(F.col(f"`{id}`").isNotNull()).distinct()
        else:
            removed = self.spark.createDataFrame([], T.StructType([T.StructField(id, T.StringType())]))
        return added, removed, c

    def missing(self, paths) -> list[str]:
        """Those of the data files that are not there any more; each folder is listed once."""
        have: dict[str, set[str]] = {}
        out = []
        for p in paths:
            folder, name = p.rsplit("/", 1)
            if folder not in have:
                have[folder] = set(self.fs.names(folder))
            if name not in have[folder]:
                out.append(p)
        return out

    def segments(self, s: Snapshot | None = None) -> dict[str, list[str]]:
        """The data files of each segment of a snapshot."""
        out: dict[str, list[str]] = {}
        for p in (s or self.snapshot()).files:
            out.setdefault(segment_of(p), []).append(p)
        return out

    def vacuum(self) -> int:
        """Delete writes that no file of the latest version is in, with their terms: older versions can then not be read.

        A write of a version to come is left alone: its commit may be under way.
        """
        s = self.snapshot()
        live = {p.split("/")[1] for p in s.files}
        gone = {n for d in ("data", "terms") for n in self.fs.names(d) if n not in live and int(n.split("-")[0]) <= s.version}
        for n in gone:
            self.fs.delete(f"data/{n}")
            self.fs.delete(f"terms/{n}")
        return len(gone)
