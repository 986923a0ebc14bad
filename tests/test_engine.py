"""Indexes, versioned tables, ingest, sync and the pure helpers."""

import json

import pytest
from pyspark.sql import functions as F

from lakefind import Engine, Schema, VersionedTable, ingest
from lakefind.engine import to_ndjson, to_table
from lakefind.errors import DocumentError, DocumentNotFound, IndexExists, IndexNotFound, IngestError, QueryParseError, SchemaError, TableError, WriterLocked
from lakefind.functions.analysis import analyze
from lakefind.functions.stemmer import stem
from lakefind.functions.values import parse_date, parse_ip, wildcard_regex
from lakefind.operators.compaction import MergePolicy, levels, plan
from lakefind.operators.search import query_tree, search
from lakefind.plans import nodes as n
from lakefind.schema import flatten, infer_documents, infer_struct, infer_value
from lakefind.sources.ingest import detect_format, expand, parse_format, read_file, read_lines


# -- pure functions ----------------------------------------------------------


@pytest.mark.parametrize(
    "words, want",
    [("running runs run", "run"), ("diabetes diabetic", "diabet"), ("fasting fast", "fast"), ("generally", "general"), ("happily", "happili"), ("hopping hopped", "hop"), ("hoping", "hope"), ("national", "nation"), ("ties", "tie"), ("skies", "sky"), ("relational", "relat"), ("consistency", "consist"), ("knightly", "knight"), ("dying", "die"), ("cry", "cri"), ("say", "say"), ("é", "é")],
)
def test_stems(words, want):
    assert {stem(w) for w in words.split()} == {want}


def test_analyzers():
    assert analyze("The Fasting, blood-samples! " + "x" * 41, "en_stem") == ["the", "fast", "blood", "sampl"]
    assert analyze("A b_c", "simple") == ["a", "b", "c"] and analyze("A b", "raw") == ["A b"] and analyze("", "simple") == []


@pytest.mark.parametrize(
    "value, kind",
    [
        (None, None), (True, "boolean"), (3, "numeric"), (2.5, "numeric"), ("x", "keyword"), ("192.168.1.1", "ip"), ("::1", "ip"), ("2024-01-15T10:00:00Z", "date"), ("2024-01-15 10:30:00", "date"), ("2024-01-15", "keyword"),
        ("20260315", "date"), ("20261301", "keyword"), ("20260132", "keyword"), ([1, 2], "numeric"), ([None, "a"], "keyword"), ([1, "two"], None), ([], None), ([[1]], None), ([None, None], None), ({"a": 1}, None),
    ],
)
def test_infer_value(value, kind):
    assert infer_value(value) == kind


def test_infer_documents(spark):
    s = infer_documents([{"name": "alice", "age": 30, "created": "2024-01-15T10:00:00Z", "_id": 1}, {"name": 7, "active": True, "user": {"address": {"city": "x"}}, "tags": ["a"]}])
    assert s.fields == {"active": "boolean", "age": "numeric", "created": "date", "name": "keyword", "tags": "keyword", "user.address.city": "keyword"} and s.multi == {"tags"}
    assert dict(flatten({"a": {"b": 1}, "c": None})) == {"a.b": 1, "c": None}
    merged, new = Schema({"a": "text"}).merge(Schema({"a": "keyword", "b": "numeric"}))
    assert merged.fields == {"a": "text", "b": "numeric"} and new == ["b"]
    t = spark.createDataFrame([], "s string, d double, t timestamp, b boolean, l array<int>, x decimal(5,2), n struct<a:string,_h:int>, _id string").schema
    assert infer_struct(t).fields == {"s": "keyword", "d": "numeric", "t": "date", "b": "boolean", "l": "numeric", "n.a": "keyword"}
    for bad in ("{", '{"fields": {"a": "geo"}}', "{}"):
        with pytest.raises(SchemaError):
            Schema.parse(bad)


def test_values():
    assert parse_date("2024-01-10T10:00:00+01:00") == parse_date("2024-01-10T09:00:00Z") == parse_date("2024-01-10 09:00:00")
    assert parse_date("20240110") == parse_date("2024-01-10")
    assert parse_ip("10.0.0.1") == "00000000000000000000ffff0a000001" and parse_ip("::1").endswith("1")
    for f, bad in ((parse_date, "x"), (parse_date, "2024-13-01"), (parse_ip, "1.2.3")):
        with pytest.raises(QueryParseError):
            f(bad)
    assert wildcard_regex("a*b?\\*.") == "^(?s:a.*b.\\*\\.)\\z"


def test_simplify():
    t = n.Term("a", 1)
    assert n.simplify(n.Bool()) == n.MatchAll() and n.simplify(n.Bool(must=(n.Bool(should=(t,)),))) == t
    assert n.simplify(n.Bool(must=(t, n.MatchNone()))) == n.MatchNone() == n.simplify(n.Bool(should=(n.MatchNone(),)))
    assert n.simplify(n.Bool(must_not=(t,))) == n.Bool(must=(n.MatchAll(),), must_not=(t,))


def named(sizes):
    return {f"s{i:02}": x for i, x in enumerate(sizes)}


@pytest.mark.parametrize(
    "sizes, policy, want",
    [
        ([100] * 10, None, [10]), ([100] * 13, None, [12]), ([100] * 7, None, []), ([100_000] * 10 + [10_000_000], None, [10]), ([10_000_000, 10_000_001], None, []), ([5_000_000] * 2, None, [2]),
        ([9_999_997, 9_999_998, 9_999_999], None, [2]), ([100_000] + [1_000_000] * 7, None, []), ([10, 20, 30, 40], (3, 5), [4]), ([10] * 6, (3, 4), [4]), ([], None, []), ([5], None, []),
    ],
)
def test_merge_plan(sizes, policy, want):
    assert [len(g) for g in plan(named(sizes), MergePolicy(*policy) if policy else MergePolicy())] == want


def test_levels():
    assert levels([100_000] * 3 + [800_000, 900_000]) == [[0, 1, 2], [3, 4]]
    assert levels([100_000] * 8 + [800_000, 1_600_000, 3_000_000])[1:] == [[8, 9], [10]]


# -- tables and ingest -------------------------------------------------------

ROWS = [("d1", "glucose", 100.0), ("d2", "a1c", 5.7), ("d3", "creatinine", 1.2), ("d4", "bun", 15.0), ("d5", "sodium", 140.0)]


def labs(spark, rows):
    return spark.createDataFrame(rows, "_id string, name string, value double")


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    assert not t.exists() and t.version() == -1
    assert t.overwrite(labs(spark, ROWS[:2])) == 0 and t.append(labs(spark, ROWS[2:])) == 1
    assert t.read().count() == 5 and t.read(0).count() == 2 and t.snapshot().rows == 5
    added, removed, c = t.changed_rows(0)
    assert sorted(r["_id"] for r in added.collect()) == ["d3", "d4", "d5"] and removed.count() == 0 and not c.removed
    assert t.changed_rows(1)[0].count() == 0 and t.changed_rows(-1)[0].count() == 5
    v = t.delete_where(F.col("_id") == "d1")
    added, removed, _ = t.changed_rows(1)
    assert {r["_id"] for r in removed.collect()} - {r["_id"] for r in added.collect()} == {"d1"} and t.version() == v
    assert t.delete_where(F.col("_id") == "nope") == v
    assert t.append(spark.createDataFrame([("d6", 1)], "_id string, extra int")) == v + 1 and t.read().where("extra = 1").count() == 1
    with pytest.raises(WriterLocked):
        t.commit({}, expected=0)
    with pytest.raises(TableError):
        t.read(99)
    for _ in range(22):
        t.commit({}, expected=t.version())
    assert t.fs.names("checkpoints") and t.read().count() == 5 and t.vacuum() >= 1 and t.read().count() == 5


def test_formats(spark, tmp_path):
    assert [detect_format(x) for x in ("a.NDJSON", "a.jsonl", "a.json", "a.csv", "a.parquet", "a.txt")] == ["ndjson", "ndjson", "json", "csv", "parquet", None]
    assert parse_format("JSONL") == "ndjson"
    (tmp_path / "a.csv").write_text("name,value,active\nx,1.5,true\ny,,false\n")
    (tmp_path / "b.ndjson").write_text('{"name":"z","value":2}\n\n{"name":"w","value":3.5}\n')
    (tmp_path / "c.json").write_text('[{"name":"p"},{"name":"q","value":1}]')
    (tmp_path / "one.json").write_text('{"name":"p"}')
    (tmp_path / "bad.ndjson").write_text('{"name":1}\n{oops\n')
    (tmp_path / "empty.csv").write_text("name\n")
    p = str(tmp_path)
    assert [r["value"] for r in read_file(spark, f"{p}/a.csv").orderBy("name").collect()] == [1.5, None]
    assert read_file(spark, f"{p}/b.ndjson").count() == 2 and read_file(spark, f"{p}/c.json").count() == 2 and read_file(spark, f"{p}/one.json").count() == 1
    assert [x.rsplit("/", 1)[1] for x in expand(spark, f"{p}/[ab].*")] == ["a.csv", "b.ndjson"]
    for bad in (lambda: read_file(spark, f"{p}/bad.ndjson"), lambda: read_file(spark, f"{p}/empty.csv"), lambda: read_file(spark, f"{p}/x.txt"), lambda: expand(spark, f"{p}/*.zip"), lambda: expand(spark, f"{p}/nope"), lambda: read_lines(spark, [], "parquet"), lambda: parse_format("xml")):
        with pytest.raises(IngestError):
            bad()
    assert read_lines(spark, ['{"a":1}', "", '{"a":2}'], "ndjson").count() == 2 and read_lines(spark, ["a,b", "1,x"], "csv").count() == 1
    assert read_lines(spark, ['[{"a":1},', '{"a":2}]'], "json").count() == 2 and read_lines(spark, ['{"a":1}'], "json").count() == 1
    t = f"file://{p}/table"
    assert ingest(spark, [f"{p}/a.csv", f"{p}/b.ndjson"], t) == 0 and VersionedTable(spark, t).read().count() == 4
    assert ingest(spark, f"{p}/c.json", t, mode="append") == 1 and VersionedTable(spark, t).read().count() == 6
    assert ingest(spark, f"{p}/a.csv", t) == 2 and VersionedTable(spark, t).read().count() == 2
    with pytest.raises(IngestError):
        ingest(spark, f"{p}/a.csv", t, mode="merge")


# -- indexes -----------------------------------------------------------------


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/data")


def test_lifecycle(engine):
    s = {"fields": {"name": "keyword"}}
    assert engine.create("x", s, dry_run=True).fields == s["fields"] and not engine.exists("x")
    with pytest.raises(SchemaError):
        engine.create("x", dry_run=True)
    with pytest.raises(IndexNotFound):
        engine.open("x")
    engine.create("x", s)
    with pytest.raises(IndexExists):
        engine.create("x", s)
    engine.create("x", s, overwrite=True)
    assert engine.list() == ["x"]
    engine.drop("x")
    with pytest.raises(IndexNotFound):
        engine.drop("x")


def test_documents(engine, tmp_path):
    docs = [
        {"_id": "d1", "name": "glucose", "notes": "fasting blood", "age": 45, "born": "20260315", "active": True, "host": "10.0.0.1", "tags": ["urgent", None, "lab"], "a": {"b": {"c": "deep"}}, "extra": 1},
        {"_id": 42, "name": True, "notes": "borderline diabetic", "born": "2024-01-15 10:30:00", "host": "::1", "tags": [], "a": None},
        {"name": 5, "tags": "one", "notes": ["two texts", "Running late"]},
        {"_id": "d1", "name": "ldl", "notes": "second version"},
    ]
    f = tmp_path / "docs.ndjson"
    f.write_text("\n".join([*map(json.dumps, docs[:3]), "", "not json", json.dumps(docs[3])]))
    idx = engine.create("docs", {"fields": {"name": "keyword", "notes": "text", "age": "numeric", "born": "date", "active": "boolean", "host": "ip", "tags": "keyword", "a.b.c": "keyword"}})
    assert idx.index(str(f)) == 3
    by = {h["_id"]: h for h in idx.hits("*", limit=10)}
    assert by["d1"]["name"] == "ldl" and by["42"]["name"] is True and len(by) == 3
    assert [h["_id"] for h in idx.hits("name:true")] == ["42"] and [h["_id"] for h in idx.hits("notes:diabetes")] == ["42"]
    assert [h["name"] for h in idx.hits("notes:run")] == [5] == [h["name"] for h in idx.hits("tags:one")]
    assert [h["_id"] for h in idx.hits("host:::1")] == ["42"] and [h["_id"] for h in idx.hits("born:[2024-01-15T10:00:00Z TO 2024-01-16]")] == ["42"]
    assert len(idx.hits(dsl={"exists": {"field": "tags"}})) == 2
    idx.index(f"{f}")  # the same again changes nothing but the made-up id
    assert idx.stats()["num_docs"] == 4
    assert idx.get("42", ["name"]) == {"name": True, "_id": "42"}
    with pytest.raises(DocumentNotFound):
        idx.get("nope")
    assert idx.delete(["42", "nope"]) == 2 and idx.stats()["num_docs"] == 3
    (tmp_path / "bad.ndjson").write_text('{"_id":"b","age":"old"}\n')
    with pytest.raises(DocumentError, match="age"):
        idx.index(str(tmp_path / "bad.ndjson"))
    assert idx.stats()["num_docs"] == 3 and idx.stats()["num_segments"] >= 1


def test_inferred_schema_evolves(engine, tmp_path):
    idx = engine.create("e")
    a, b = tmp_path / "a.ndjson", tmp_path / "b.ndjson"
    a.write_text('{"_id":"1","name":"x"}\n{"_id":"2","name":"y","n":1}\n')
    b.write_text('{"_id":"3","name":["p","q"],"when":"2024-01-15T10:00:00Z","user":{"id":7}}\n')
    idx.index(str(a))
    idx.index(str(b))
    assert idx.schema.fields == {"name": "keyword", "n": "numeric", "when": "date", "user.id": "numeric"} and idx.schema.multi == {"name"}
    assert [h["_id"] for h in idx.hits("name:x")] == ["1"] and [h["_id"] for h in idx.hits("name:q user.id:7")] == ["3"]
    assert [h["_id"] for h in idx.hits("*", sort="n:desc", limit=1)] == ["2"]
    assert idx.aggregate({"t": {"terms": {"field": "name"}}})["t"]["buckets"][0] == {"key": "p", "doc_count": 1}


def test_sync_and_gap(spark, engine, tmp_path):
    path = f"file://{tmp_path}/source"
    t = VersionedTable(spark, path)
    t.overwrite(labs(spark, ROWS))
    idx = engine.create("labs", source=path)
    assert idx.schema.fields == {"name": "keyword", "value": "numeric"} and idx.stats()["gap_versions"] == 1
    assert len(idx.hits("*")) == 5  # nothing is indexed yet: all of it is in the gap
    assert idx.sync(segment_size=2) == 5 and idx.stats()["num_segments"] >= 2 and idx.sync() == 0
    assert idx.force_merge() == 1 and idx.stats()["num_segments"] == 1
    t.append(labs(spark, [("d1", "ldl", 1.0), ("d6", "glucose", 2.0)]))
    t.delete_where(F.col("_id") == "d2")
    # the gap's d1 no longer matches, d2 is gone before any sync
    assert [h["_id"] for h in idx.hits("name:glucose")] == ["d6"] and len(idx.hits(dsl={"term": {"name": "a1c"}})) == 0
    assert len(idx.hits("name:glucose", include_gap=False)) == 1
    assert idx.get("d1")["name"] == "ldl" and idx.aggregate({"n": {"value_count": {"field": "name"}}})["n"]["value"] == len(idx.hits("*"))
    idx.sync()
    assert idx.index_version == t.version() and idx.gap() is None
    assert [h["_id"] for h in idx.hits("name:glucose", include_gap=False)] == ["d6"] and idx.stats()["num_docs"] == 5
    assert idx.reindex(0) == 5 and idx.index_version == 0 and idx.reindex() == 6 - 1
    with pytest.raises(TableError):
        engine.create("none").sync()


def test_many_rows_in_one_sync(spark, engine, tmp_path):
    path = f"file://{tmp_path}/source"
    rows = spark.range(1000).select(F.col("id").alias("_id"), (F.col("id") % 7).cast("double").alias("v"))
    VersionedTable(spark, path).overwrite(rows)
    idx = engine.create("many", source=path)
    assert idx.sync(segment_size=100) == 1000
    assert len(idx.hits("v:3", limit=None, sort=None)) == 143


def test_streaming_sync(spark, engine, tmp_path):
    path = f"file://{tmp_path}/source"
    t = VersionedTable(spark, path)
    t.overwrite(labs(spark, ROWS[:3]))
    idx = engine.create("s", source=path)
    for want in (3, 5):
        q = idx.start_sync(available_now=True)
        q.awaitTermination(120)
        assert q.exception() is None and engine.open("s").stats()["num_docs"] == want
        t.append(labs(spark, ROWS[3:]))


def test_output():
    assert to_ndjson([{"a": 1}, {"a": "é"}]) == '{"a": 1}\n{"a": "é"}\n'
    assert to_table([{"name": "x", "n": 1}, {"name": None, "other": 2}]) == "name\tn\n--------\t--------\nx\t1\n\t\n" and to_table([]) == ""


def test_term_dictionary(spark, engine, tmp_path):
    """Only segments with the words are read, and hits and scores are those of a full scan."""
    path = f"file://{tmp_path}/source"
    rows = [(f"d{i:03}", f"common words w{i // 20} x{i % 7}" + " long" * (i % 5)) for i in range(100)] + [("none", None)]
    t = VersionedTable(spark, path)
    t.overwrite(spark.createDataFrame(rows, "_id string, body string").coalesce(1))
    idx = engine.create("terms", {"fields": {"body": "text"}}, source=path)
    idx.sync(segment_size=20, max_segments=100)
    assert idx.stats()["num_segments"] > 3
    plain = idx.corpus()
    for query in ("body:w3", "body:w3 body:x5", '+body:w1 +body:"x2 long"', "+body:common -body:w0", "body:nope", "body:w1 OR _id:d099", 'body:"words w2"~3'):
        tree = n.simplify(query_tree(idx.schema, query))
        c = idx.corpus(tree)
        a, b = (search(x, query, limit=200, score=True, fields=[]).collect() for x in (c, plain))
        assert [r["_id"] for r in a] == [r["_id"] for r in b] and all(abs(x["_score"] - y["_score"]) < 1e-9 for x, y in zip(a, b)), query
    assert len(idx.corpus(n.Match("body", "w3")).df.inputFiles()) < len(plain.df.inputFiles())
    t.append(spark.createDataFrame([("d000", "w3 again"), ("new", "w3")], "_id string, body string"))
    assert {h["_id"] for h in idx.hits("body:w3", limit=100)} == {f"d{i:03}" for i in range(60, 80)} | {"d000", "new"}
    hits = idx.hits("body:w3", limit=1, score=True)
    idx.sync(max_segments=2)
    assert hits == idx.hits("body:w3", limit=1, score=True)


def test_typed_and_json_documents_agree(spark):
    """Columns cast as they are give what their JSON gives when it is parsed."""
    import datetime as dt

    from lakefind.operators import documents as d

    rows = [
        ("1", "x", 1, 2.5, True, dt.datetime(2024, 1, 15, 10, 30), dt.date(2024, 1, 15), "2024-01-15T10:00:00Z", "10.0.0.1", ["a", None, "b"], [1, 2], ("p", 7)),
        ("2", None, None, None, None, None, None, None, None, None, None, None),
        (None, "y", -3, 1e20, False, dt.datetime(1969, 12, 31, 23, 59, 59, 123456), dt.date(2000, 2, 29), "no date", "no ip", [], [None], (None, None)),
    ]
    df = spark.createDataFrame(rows, "_id string, s string, i int, f double, b boolean, t timestamp, d date, ts string, ip string, l array<string>, n array<int>, o struct<p: string, q: int>")
    fields = {
        "s": "keyword", "i": "numeric", "f": "numeric", "b": "boolean", "t": "date", "d": "date", "ts": "date", "ip": "ip", "l": "keyword", "n": "numeric", "o.p": "keyword", "o.q": "numeric", "o": "keyword", "gone": "text",
    }
    for kinds in (fields, {**fields, "i": "keyword", "f": "keyword", "b": "keyword", "d": "keyword", "s": "numeric", "t": "boolean", "l": "ip", "n": "keyword"}):
        schema = Schema(kinds, {"l", "n"})
        typed = d.source_of(df.where("_id is not null"))
        one, two = (sorted(map(str, d.build(x, schema).select(*d.column_names(schema), "_error").collect())) for x in (typed, typed.drop(d.ROW)))
        assert one == two
    assert d.array_fields(d.source_of(df), Schema(fields)) == {"l", "n"}


def test_merges_leave_one_segment(spark, engine, tmp_path, monkeypatch):
    """A segment may have several files; the old ones are gone, a write under way is not."""
    import lakefind.engine

    monkeypatch.setattr(lakefind.engine, "MERGE_ROWS", 20)
    rows = spark.range(100).select(F.col("id").cast("string").alias("_id"), F.concat(F.lit("text "), F.col("id")).alias("body"))
    idx = engine.create("m", {"fields": {"body": "text"}})
    for lo in (0, 50):
        idx.index(rows.where(f"cast(_id as int) >= {lo} and cast(_id as int) < {lo + 50}").repartition(4))
    assert idx.stats()["num_segments"] >= 2
    pending = f"data/{idx.table.version() + 5:020d}-feed"
    idx.table.fs.write(f"{pending}/part-0.parquet", "x")
    assert idx.force_merge() == 1 and idx.stats()["num_segments"] == 1 and len(idx.table.snapshot().files) > 1
    assert [len(idx.table.fs.names(n)) for n in ("data", "terms")] == [2, 1] and idx.table.fs.exists(f"{pending}/part-0.parquet")
    assert len(idx.hits("body:text", limit=1000)) == 100 and idx.get("7")["body"] == "text 7"
    idx.index(rows.where("_id = '7'").withColumn("body", F.lit("new")))
    assert idx.get("7")["body"] == "new" and idx.stats()["num_docs"] == 100 and idx.force_merge() == 1 and idx.force_merge() == 0


def test_a_merge_task_has_few_bytes(spark, engine, monkeypatch):
    """However few documents there are, no task of a merge takes more than its bytes of them; small segments become one file."""
    import lakefind.engine

    rows = spark.range(400, numPartitions=1).select(F.col("id").cast("string").alias("_id"), F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(f"-{i}")), 256) for i in range(8)]).alias("body"))
    idx = engine.create("b", {"fields": {"body": "text"}})
    for lo in (0, 100, 200, 300):
        idx.index(rows.where(f"cast(_id as int) >= {lo} and cast(_id as int) < {lo + 100}").coalesce(1))
    files = list(idx.table.snapshot().files)
    largest, total = max(idx.table.size_of([f]) for f in files), idx.table.size_of(files)
    before = sorted(map(tuple, idx.table.read().collect()))
    settings = {k: spark.conf.get(f"spark.sql.files.{k}", None) for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum")}
    bound = total // 3
    assert largest <= bound
    monkeypatch.setattr(lakefind.engine, "MERGE_BYTES", bound)
    assert idx.force_merge() == 1 and idx.stats()["num_segments"] == 1 and sorted(map(tuple, idx.table.read().collect())) == before
    merged = list(idx.table.snapshot().files)
    assert len(merged) >= 3 and max(idx.table.size_of([f]) for f in merged) <= 1.2 * bound
    assert settings == {k: spark.conf.get(f"spark.sql.files.{k}", None) for k in settings}
    monkeypatch.undo()
    idx.index(rows.where("_id = '7'"))
    assert idx.force_merge() == 1 and len(idx.table.snapshot().files) == 1 and sorted(map(tuple, idx.table.read().collect())) == before


def test_a_failed_merge_is_put_off(spark, engine, tmp_path, monkeypatch, caplog):
    path = f"file://{tmp_path}/source"
    t = VersionedTable(spark, path)
    t.overwrite(labs(spark, ROWS))
    idx = engine.create("f", source=path)
    monkeypatch.setattr(idx, "_merge", lambda *a: 1 / 0)
    assert idx.sync(segment_size=1, max_segments=2) == 5 and idx.metrics["merge_failures"] == 1 and "merge failed" in caplog.text
    monkeypatch.undo()
    assert engine.open("f").stats()["compaction"] | {"last_segment_at": 0} == {"segment_size": 1, "merge_interval_secs": 300.0, "max_segments": 2, "last_segment_at": 0, "last_merge_at": None}
    t.append(labs(spark, [("d9", "new", 1.0)]))
    again = engine.open("f")
    assert again.sync() == 1 and again.stats()["compaction"]["max_segments"] == 2 and again.metrics["merges"] == 1 and again.stats()["compaction"]["last_merge_at"]
    assert again.sync(once=False, polls=2, poll_interval=0.0) == 0 and again.metrics["polls"] == 3 and again.metrics["poll_seconds_count"] == 3


def test_bad_documents_leave_no_staging(engine, tmp_path):
    idx = engine.create("s", {"fields": {"n": "numeric"}})
    (tmp_path / "bad.ndjson").write_text('{"_id":"b","n":"x"}\n')
    with pytest.raises(DocumentError):
        idx.index(str(tmp_path / "bad.ndjson"))
    assert not [n for n in engine.fs.names("s") if n.startswith("staging")]


def test_order_of_a_dataframe(spark, engine):
    df = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("a", "older", 0)], "_id string, v string, at int").repartition(3)
    idx = engine.create("o", {"fields": {"v": "keyword"}})
    idx.index(df, order_by="at")
    assert idx.get("a")["v"] == "new"
    with pytest.raises(SchemaError):
        idx.index(df, order_by="nope")


def test_ingest_of_lines_and_of_nothing(spark, tmp_path):
    from lakefind import Lines

    t = f"file://{tmp_path}/t"
    assert ingest(spark, Lines(["a,b", "1,x"], "csv"), t) == 0 and VersionedTable(spark, t).read().count() == 1
    (tmp_path / "empty.ndjson").write_text("\n")
    assert ingest(spark, str(tmp_path / "empty.ndjson"), t) is None and VersionedTable(spark, t).version() == 0
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,z\n3,4\n")
    ingest(spark, str(tmp_path / "*.csv"), t)
    assert sorted(map(tuple, VersionedTable(spark, t).read().select("x", "y", "z").collect()), key=str) == [(1, 2, None), (None, 3, 4)]
