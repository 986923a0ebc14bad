"""Indexes over versioned tables: the library's front door.

    engine = Engine(spark, "/data/lake")
    idx = engine.create("labs", schema={"fields": {"name": "keyword", "notes": "text"}})
    idx.index("labs.ndjson")
    idx.search('+name:"glucose" notes:fasting', limit=10).show()

An index is a versioned table of typed documents (``_id``, ``_source``, a column
a field, stored tokens a text field).  Its files are the segments; the source
version it has seen is in the same commit as the files, so a crash never leaves
one without the other.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import DocumentNotFound, IndexExists, IndexNotFound, IngestError, LakefindError, SchemaError, TableError
from .operators import aggregations, documents, mutate, terms
from .operators import search as searching
from .operators.compaction import MergePolicy, plan
from .plans.compile import Corpus
from .plans.nodes import Node, simplify
from .schema import Schema, infer_json, infer_struct
from .sources.files import Files
from .sources.ingest import Lines, detect_format, expand, parse_format, read_files, read_lines, read_ndjson_documents
from .sources.table import SEQ, VersionedTable

SEGMENT_SIZE = 10_000
MAX_SEGMENTS = 10
MERGE_INTERVAL = 300.0
#: Documents, and bytes of segments, that one task reads and writes when segments are merged.
MERGE_ROWS = 1_000_000
MERGE_BYTES = 128 << 20

log = logging.getLogger("lakefind")


class Engine:
    """The indexes in a data directory."""

    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark, self.data_dir = spark, data_dir.rstrip("/")
        self.fs = Files(spark, self.data_dir)

    def exists(self, name: str) -> bool:
        return self.fs.exists(f"{name}/config.json")

    def list(self) -> list[str]:
        return [n for n in self.fs.names() if self.exists(n)]

    def create(self, name: str, schema: str | dict | Schema | None = None, *, source: str | None = None, overwrite: bool = False, dry_run: bool = False) -> Index | Schema:
        """A new index.

        Without a schema, fields are inferred from the source table or from the
        documents as they come.  dry_run returns the schema and writes nothing.
        """
        if schema is not None:
            inferred, s = False, Schema.parse(schema)
        elif source is not None:
            inferred, s = True, infer_struct(VersionedTable(self.spark, source).schema())
        else:
            inferred, s = True, Schema()
        if dry_run:
            if schema is None and source is None:
                raise SchemaError("a dry run needs a schema or a source")
            return s
        if self.exists(name):
            if not overwrite:
                raise IndexExists(f"index '{name}' exists")
            self.drop(name)
        config = {"schema": s.to_dict(), "inferred": inferred or source is not None, "source": source}
        if not self.fs.create(f"{name}/config.json", json.dumps(config)):
            raise IndexExists(f"index '{name}' exists")
        return Index(self, name)

    def open(self, name: str) -> Index:
        if not self.exists(name):
            raise IndexNotFound(f"index '{name}' not found")
        return Index(self, name)

    def drop(self, name: str) -> None:
        if not self.exists(name):
            raise IndexNotFound(f"index '{name}' not found")
        self.fs.delete(name)


class Index:
    """One index; made by :class:`Engine`."""

    def __init__(self, engine: Engine, name: str):
        self.engine, self.name, self.spark = engine, name, engine.spark
        self.config = {"source": None, "inferred": False} | json.loads(engine.fs.read(f"{name}/config.json"))
        self.table = VersionedTable(self.spark, f"{engine.data_dir}/{name}/index")
        #: Counters, gauges (``gauge_...``), and the count and sum of durations in seconds, of this object's work.
        self.metrics: dict[str, float] = dict.fromkeys(
            ("docs_indexed", "docs_deleted", "docs_failed", "segments_created", "polls", "syncs", "merges", "merge_failures", "searches", "gauge_source_version", "gauge_index_version", "gauge_gap_versions", "gauge_segments", "poll_seconds_count", "poll_seconds_sum", "merge_seconds_count", "merge_seconds_sum"), 0
        )
        self._staged: list[str] = []

    def _took(self, what: str, began: float) -> None:
        self.metrics[f"{what}_seconds_count"] += 1
        self.metrics[f"{what}_seconds_sum"] += time.monotonic() - began

    # -- state ---------------------------------------------------------------

    def _meta(self) -> dict:
        return self.table.meta() if self.table.exists() else {}

    @property
    def schema(self) -> Schema:
        """The schema as of the last commit."""
        return Schema.parse(self._meta().get("schema") or self.config["schema"])

    @property
    def index_version(self) -> int:
        """The source version that the index has seen, -1 for none."""
        return self._meta().get("index_version", -1)

    @property
    def source(self) -> VersionedTable | None:
        return VersionedTable(self.spark, self.config["source"]) if self.config["source"] else None

    def _base(self, schema: Schema) -> DataFrame:
        want = documents.empty_struct(schema)
        return self.table.read() if self.table.exists() and self.table.snapshot().files else self.spark.createDataFrame([], want)

    # -- writing -------------------------------------------------------------

    def _documents(self, source: DataFrame | Lines | str | Iterable[str], format: str | None, order_by: str | None) -> DataFrame:
        """``_id``, ``_source`` and ``__lf_seq`` of what is to be indexed."""
        if isinstance(source, Lines):
            if parse_format(source.format) == "ndjson":
                rows = self.spark.createDataFrame([(x,) for x in source.lines if x.strip()], "_source string")
                ok = F.schema_of_variant(F.try_parse_json("_source")).startswith("OBJECT")
                return rows.where(ok).select(F.lit(None).cast("string").alias("_id"), "_source", F.array(F.monotonically_increasing_id()).alias(SEQ))
            source = read_lines(self.spark, source.lines, source.format)
        if isinstance(source, DataFrame):
            if order_by is not None and order_by not in source.columns:
                raise SchemaError(f"there is no column '{order_by}' to order by")
            order = F.monotonically_increasing_id() if order_by is None else F.col("`" + order_by.replace("`", "``") + "`")
            return documents.source_of(source.withColumn(SEQ, F.array(order)), SEQ)
        paths = [p for s in ([source] if isinstance(source, str) else source) for p in expand(self.spark, s)]
        kinds = {parse_format(format) if format else detect_format(p) or "ndjson" for p in paths}
        if kinds == {"ndjson"}:
            return read_ndjson_documents(self.spark, paths).select(F.lit(None).cast("string").alias("_id"), "_source", SEQ)
        rows = read_files(self.spark, paths, format, seq=True)
        if rows is None:
            raise IngestError(f"no rows in {', '.join(paths)}")
        return documents.source_of(rows, SEQ)

    def index(self, source: DataFrame | Lines | str | Iterable[str], *, format: str | None = None, order_by: str | None = None) -> int:
        """Add documents, replacing those with the same id; the first bad document stops it all.

        source is a DataFrame of typed columns, paths of files, or lines.  Where
        the schema is inferred, new fields are added and the index is built anew.
        Of several documents with an id the last one stays: files count in the
        order they are given, and a DataFrame's rows in that of its partitions,
        which for a scan of several files is not the files' order; order_by names
        a column that says it.
        """
        docs = self._documents(source, format, order_by)
        schema = self.schema
        if self.config["inferred"]:
            known = infer_struct(docs.schema[documents.ROW].dataType) if documents.ROW in docs.columns else infer_json(docs, seq=SEQ)
            schema = schema.merge(known)[0]
        else:
            schema = Schema(schema.fields, schema.multi | documents.array_fields(docs, schema))
        return self._apply(docs, None, schema, None, True)

    def _apply(self, docs: DataFrame | None, removed: DataFrame | None, schema: Schema, index_version: int | None, strict: bool, segment_size: int = 0, compaction: dict | None = None) -> int:
        """Removals first, then the documents, in one commit; the number of documents written.

        Only segments that hold a replaced or removed id are written again.
        """
        last = self.table.version()
        snapshot = self.table.snapshot(last) if last >= 0 else None
        old_schema = self.schema
        meta = self._meta() | {"schema": schema.to_dict(), "index_version": self.index_version if index_version is None else index_version}
        if compaction is not None:
            meta["compaction"] = self._compaction() | compaction
        struct = documents.empty_struct(schema)
        columns = documents.column_names(schema)
        add: dict[str, int] = {}
        try:
            if docs is not None:
                # built once, into the index's own folder: what is checked is what is written
                staged = self._stage(documents.build(docs, schema))
                if strict:
                    good = documents.strict(staged)
                else:
                    good, bad = documents.lenient(staged)
                    self.metrics["docs_failed"] += bad.count()
                new = mutate.last_wins(good, seq=SEQ).select(*columns)
                add = self._write(new, struct, segment_size)
            rows = sum(add.values())
            remove: list[str] = []
            if snapshot and snapshot.files:
                rebuilt = schema.fields != old_schema.fields or schema.multi != old_schema.multi
                ids = self.table.files(add, struct).select("_id")
                if removed is not None:
                    ids = ids.unionByName(removed.select(F.col("_id").cast("string").alias("_id")))
                base = self.table.files(snapshot.files, documents.empty_struct(old_schema))
                if rebuilt:
                    remove = list(snapshot.files)
                    kept = documents.build(mutate.delete(base.select("_id", "_source"), ids), schema).select(*columns)
                else:
                    remove = self.table.files_with_ids(snapshot, ids, "_id")
                    kept = mutate.delete(self.table.files(remove, struct), ids).select(*columns)
                if remove:
                    before = sum(snapshot.files[p] for p in remove)
                    rest = self._write(kept, struct)
                    self.metrics["docs_deleted"] += before - sum(rest.values())
                    add |= rest
            self.table.commit(add, remove, schema=struct, meta=meta, expected=last)
        finally:
            self._unstage()
        self.metrics["docs_indexed"] += rows
        self.metrics["segments_created"] += len(add)
        return rows

    def _compaction(self) -> dict:
        return self._meta().get("compaction") or {"segment_size": SEGMENT_SIZE, "merge_interval_secs": MERGE_INTERVAL, "max_segments": MAX_SEGMENTS, "last_segment_at": None, "last_merge_at": None}

    def _write(self, docs: DataFrame, struct, segment_size: int = 0) -> dict[str, int]:
        """New segments and their term dictionary."""
        files = self.table.write_files(docs, max_rows=segment_size)
        terms.write(self.table, files, struct)
        return files

    def _stage(self, built: DataFrame) -> DataFrame:
        """Built documents, written once: made-up ids and the check then hold for what is stored."""
        import uuid

        name = f"{self.name}/staging-{uuid.uuid4().hex}"
        self._staged.append(name)
        path = f"{self.engine.data_dir}/{name}"
        built.write.parquet(path)
        return self.spark.read.schema(built.schema).parquet(path)

    def _unstage(self) -> None:
        while self._staged:
            self.engine.fs.delete(self._staged.pop())

    def delete(self, ids: DataFrame | Iterable[str]) -> int:
        """Delete documents by id; the number of requests, whether or not they hit."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(str(i),) for i in ids], "_id string")
        n = ids.count()
        self._apply(None, ids, self.schema, None, True)
        return n

    # -- source table --------------------------------------------------------

    def sync(
        self,
        *,
        once: bool = True,
        segment_size: int | None = None,
        max_segments: int | None = None,
        merge_interval: float | None = None,
        force_merge: bool = False,
        poll_interval: float = 10.0,
        polls: int | None = None,
    ) -> int:
        """Bring the index up to its source's latest version, then merge segments.

        Bad documents are counted and left out.  once=False goes on polling
        (``polls`` times, or until interrupted) and merges when merge_interval
        seconds have passed since it last did; force_merge only merges all
        segments into one.  Settings that are not given are those of the last
        sync, which the index keeps.  A failed merge is logged and put off.
        Returns the number of documents indexed.
        """
        if force_merge:
            self.force_merge()
            return 0
        given = {"segment_size": segment_size, "max_segments": max_segments, "merge_interval_secs": merge_interval}
        settings = self._compaction() | {k: v for k, v in given.items() if v is not None}
        total, n, merged_at = 0, 0, None
        while True:
            began = time.monotonic()
            self.metrics["polls"] += 1
            total += self._pull(settings)
            self._took("poll", began)
            if once or merged_at is None or time.monotonic() - merged_at >= settings["merge_interval_secs"]:
                merged_at = time.monotonic()
                self.compact(max_segments=settings["max_segments"])
            n += 1
            if once or (polls is not None and n >= polls):
                return total
            time.sleep(poll_interval)

    def _pull(self, settings: dict) -> int:
        source = self.source
        if source is None:
            raise TableError(f"index '{self.name}' has no source table")
        head, seen = source.version(), self.index_version
        self.metrics |= {"gauge_source_version": head, "gauge_index_version": seen, "gauge_gap_versions": max(0, head - seen)}
        if head == seen or head < 0:
            return 0
        added, removed, changes = self._source_changes(source, seen)
        self.metrics["syncs"] += 1
        settings = settings | {"last_segment_at": datetime.now(UTC).isoformat(timespec="seconds")}
        if not changes.added and not changes.removed:
            self._apply(None, None, self.schema, head, False, compaction=settings)
            rows = 0
        else:
            docs = documents.source_of(added, SEQ)
            schema, known = self.schema, infer_struct(docs.schema[documents.ROW].dataType)
            if self.config["inferred"]:
                schema = schema.merge(known)[0]
            else:
                schema = Schema(schema.fields, schema.multi | (known.multi & schema.fields.keys()))
            rows = self._apply(docs, removed, schema, head, False, settings["segment_size"], settings)
        self.metrics |= {"gauge_index_version": head, "gauge_gap_versions": 0}
        return rows

    def _source_changes(self, source: VersionedTable, seen: int):
        """Changes since a version, added rows in order; everything, if that version cannot be read any more."""
        try:
            return source.changed_rows(seen, seq=True)
        except TableError as e:
            log.warning("index '%s': full reload, %s", self.name, e)
            added, _, c = source.changed_rows(-1, seq=True)
            ids = self._base(self.schema).select("_id")
            return added, ids, c

    def reindex(self, as_of_version: int | None = None) -> int:
        """Build the index anew from the source, at a version or the latest; the number of documents."""
        source = self.source
        if source is None:
            raise TableError(f"index '{self.name}' has no source table")
        v = source.version() if as_of_version is None else as_of_version
        rows = source.in_order(source.snapshot(v).files, source.schema(v))
        docs = documents.source_of(rows, SEQ)
        inferred = infer_struct(docs.schema[documents.ROW].dataType)
        schema = Schema.parse(self.config["schema"])
        schema = schema.merge(inferred)[0] if self.config["inferred"] else Schema(schema.fields, schema.multi | (inferred.multi & schema.fields.keys()))
        last = self.table.version()
        old = self.table.snapshot(last).files if last >= 0 else {}
        struct = documents.empty_struct(schema)
        meta = self._meta() | {"schema": schema.to_dict(), "index_version": v}
        try:
            good, bad = documents.lenient(self._stage(documents.build(docs, schema)))
            self.metrics["docs_failed"] += bad.count()
            add = self._write(mutate.last_wins(good, seq=SEQ).select(*documents.column_names(schema)), struct)
            self.table.commit(add, old, schema=struct, meta=meta, expected=last)
        finally:
            self._unstage()
        return sum(add.values())

    def start_sync(self, *, available_now: bool = False, interval: str = "10 seconds", segment_size: int | None = None):
        """A streaming query over the source's commits that keeps the index in step."""
        from .streaming.follow import follow

        return follow(self, available_now=available_now, interval=interval, segment_size=segment_size)

    # -- segments ------------------------------------------------------------

    def _merge(self, groups: list[list[str]], gc: bool) -> int:
        """Make one segment of each group of segments; a task has MERGE_BYTES, or what MERGE_ROWS documents take, at most."""
        s = self.table.snapshot()
        parts = self.table.segments(s)
        struct = documents.empty_struct(self.schema)
        add: dict[str, int] = {}
        began = time.monotonic()
        for g in groups:
            paths = [p for name in g for p in parts[name]]
            size, rows = self.table.size_of(paths), sum(s.files[p] for p in paths)
            files = self.table.merge_files(paths, struct, min(MERGE_BYTES, -(-size * MERGE_ROWS // max(1, rows))))
            terms.write(self.table, files, struct)
            add |= files
        meta = self._meta()
        meta["compaction"] = self._compaction() | {"last_merge_at": datetime.now(UTC).isoformat(timespec="seconds")}
        self.table.commit(add, [p for g in groups for name in g for p in parts[name]], meta=meta, expected=s.version)
        self.metrics["merges"] += len(groups)
        self._took("merge", began)
        if gc:
            self.vacuum()
        self.metrics["gauge_segments"] = len(self.table.segments())
        return len(groups)

    def compact(self, *, max_segments: int = MAX_SEGMENTS, gc: bool = True) -> int:
        """Merge levels that are full; the number of merges.

        A merge that fails, such as by another writer's commit, is logged and
        put off.  gc deletes the merged segments' files; results that still read
        them have to be taken before.
        """
        if not self.table.exists():
            return 0
        s = self.table.snapshot()
        sizes = {name: sum(s.files[p] for p in paths) for name, paths in self.table.segments(s).items()}
        self.metrics["gauge_segments"] = len(sizes)
        if len(sizes) < 2 or not (groups := plan(sizes, MergePolicy.of(max_segments))):
            return 0
        try:
            return self._merge(groups, gc)
        except Exception as e:  # noqa: BLE001 - whatever stops a merge, the index is as it was
            log.warning("index '%s': merge failed: %s", self.name, e)
            self.metrics["merge_failures"] += 1
            return 0

    def force_merge(self, *, gc: bool = True) -> int:
        """All segments into one."""
        if not self.table.exists() or len(names := list(self.table.segments())) < 2:
            return 0
        return self._merge([names], gc)

    def vacuum(self) -> int:
        """Delete the files that the latest commit does not have; the number of writes deleted."""
        return self.table.vacuum()

    # -- reading -------------------------------------------------------------

    def gap(self) -> tuple[DataFrame, DataFrame] | None:
        """(documents, removed ids) of the source versions the index has not seen; None if it is in step."""
        source = self.source
        if source is None:
            return None
        head, seen = source.version(), self.index_version
        if head < 0 or head == seen:
            return None
        added, removed, c = self._source_changes(source, seen)
        if not c.added and not c.removed:
            return None
        schema = self.schema
        docs = documents.source_of(added, SEQ)
        # rows without an id get one that stays the same from one scan to the next
        docs = docs.withColumn("_id", F.coalesce("_id", F.concat(F.lit("gap-"), F.array_join(F.col(SEQ).cast("array<string>"), "-"))))
        good, _ = documents.lenient(documents.build(docs, schema))
        return mutate.last_wins(good, seq=SEQ).select(*documents.column_names(schema)), removed

    def corpus(self, tree: Node | None = None, *, include_gap: bool = True, tier: str | None = None) -> Corpus:
        """What is searched: the index and, by default, the source's newer versions merged in.

        With a query tree, only the segments that can have a match are read.
        """
        schema = self.schema
        df = self._base(schema)
        stored = {f: documents.TOKENS + f for f, k in schema.fields.items() if k == "text"}
        known: dict[tuple, float] = {}
        whole = None
        plain = Corpus(df, schema, "_id", "en_stem", {}, stored, True)
        words = terms.wanted(tree, plain) if tree is not None and self.table.exists() else set()
        gap = self.gap() if include_gap else None
        if words:
            s = self.table.snapshot()
            found = terms.lookup(self.table, s, words)
            files = terms.candidates(tree, plain, found, set(s.files))
            known, whole = ({}, df) if gap is not None else (terms.statistics(s, found), df)
            df = self.table.files(sorted(files), documents.empty_struct(schema))
        if gap is not None:
            df = searching.merged(df, gap[0], gap[1], tier=tier)
            whole = None if whole is None else searching.merged(whole, gap[0], gap[1])
        elif tier:
            df = df.withColumn(tier, F.lit(1))
        return Corpus(df, schema, "_id", "en_stem", {}, stored, True, known, whole)

    def search(self, query: str | None = None, *, filter: str | None = None, dsl: str | dict | None = None, limit: int | None = 20, offset: int = 0, fields: list[str] | None = None, sort: str | None = None, score: bool = False, include_gap: bool = True, source: bool = True) -> DataFrame:
        """The best documents; see :func:`lakefind.operators.search.search`.

        With source, ``_source`` comes along when no fields are named.
        """
        self.metrics["searches"] += 1
        if fields is None and not source:
            fields = list(self.schema.fields)
        elif fields is not None:
            # a nested field is returned by its top-level name or in full
            fields = [f for f in self.schema.fields if f in fields or f.split(".")[0] in fields]
        tree = simplify(searching.query_tree(self.schema, query, filter, dsl))
        return searching.search(self.corpus(tree, include_gap=include_gap), query, filter=filter, dsl=dsl, limit=limit, offset=offset, fields=fields, sort=sort, score=score)

    def hits(self, *args, fields: list[str] | None = None, score: bool = False, **options) -> list[dict]:
        """The hits of :meth:`search` as dicts: the documents as they came, cut to the named top-level fields."""
        rows = self.search(*args, score=score, **options).collect()
        out = []
        for r in rows:
            doc = json.loads(r["_source"])
            doc = {k: v for k, v in doc.items() if fields is None or k in fields} | {"_id": r["_id"]}
            out.append(doc | ({"_score": r["_score"]} if score else {}))
        return out

    def aggregate(self, aggs: str | dict, query: str | None = None, *, filter: str | None = None, dsl: str | dict | None = None, include_gap: bool = True, exact: bool = False) -> dict:
        """Aggregations over the documents that match; all, without a query."""
        tree = where = None
        if query is not None or filter is not None or dsl is not None:
            tree = searching.query_tree(self.schema, query, filter, dsl)
        c = self.corpus(None if tree is None else simplify(tree), include_gap=include_gap)
        if tree is not None:
            where = searching.matching(c, tree)
        return aggregations.aggregate(c, aggs, where=where, exact=exact)

    def get(self, doc_id, fields: list[str] | None = None) -> dict:
        """The document with this id; an error if there is none."""
        rows = searching.get(self.corpus(), doc_id, ["_source"]).collect()
        if not rows:
            raise DocumentNotFound(f"document '{doc_id}' not found")
        doc = json.loads(rows[0]["_source"])
        return {k: v for k, v in doc.items() if fields is None or k in fields} | {"_id": rows[0]["_id"]}

    def stats(self) -> dict:
        """Documents, segments, fields and versions."""
        s = self.table.snapshot() if self.table.exists() else None
        source = self.source
        head = source.version() if source is not None else None
        more = {"compaction": self._compaction()} if self._meta().get("compaction") else {}
        return {
            "name": self.name, "num_docs": s.rows if s else 0, "num_segments": len(self.table.segments(s)) if s else 0, "fields": dict(self.schema.fields), "inferred": self.config["inferred"],
            "index_version": self.index_version, "source": self.config["source"], "source_version": head, "gap_versions": max(0, head - self.index_version) if head is not None else 0, "metrics": dict(self.metrics), **more,
        }


def to_ndjson(hits: Iterable[dict]) -> str:
    """One JSON object a line."""
    return "".join(json.dumps(h, ensure_ascii=False) + "\n" for h in hits)


def to_table(hits: list[dict]) -> str:
    """Tab-separated text; the columns are those of the first hit."""
    if not hits:
        return ""
    names = list(hits[0])
    show = lambda v: v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)
    lines = ["\t".join(names), "\t".join("-" * max(8, len(n)) for n in names)]
    return "\n".join(lines + ["\t".join(show(h.get(n)) for n in names) for h in hits]) + "\n"


__all__ = ["Engine", "Index", "LakefindError", "to_ndjson", "to_table"]
