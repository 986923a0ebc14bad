"""Registered queries of whole indexes, tables and files: lifecycle, order of versions, merging, ingest, errors."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .engine import Engine, to_ndjson, to_table
from .errors import DocumentNotFound, IndexExists, IndexNotFound, IngestError, LakefindError, QueryParseError, SchemaError, TableError, WriterLocked
from .functions.analysis import analyze
from .functions.values import ip_key, parse_ip, wildcard_regex
from .operators import aggregations, documents
from .operators import search as searching
from .plans.compile import Corpus
from .queries import _BM25, _DOCS, corpus, load, query, scratch
from .schema import Schema
from .sources.files import Files
from .sources.ingest import Lines, detect_format, expand, ingest, read_lines, read_ndjson_documents
from .sources.table import VersionedTable

_CUSTOMERS = "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name, c_acctbal FROM customer"
_FIELDS = {"fields": {"c_name": "keyword", "c_acctbal": "numeric"}}


def _customers(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("_id"), "c_name", "c_acctbal", "c_mktsegment")


def _old(customers):
    """An older state of the customers in debt: a small part of the table."""
    return customers.where("c_acctbal < -800").withColumn("c_acctbal", F.lit(0.0)).withColumn("c_name", F.lit("old"))


def _all(idx, fields=("c_name", "c_acctbal"), **options):
    return idx.search("*", limit=None, fields=list(fields), **options)


# -- the order of versions ---------------------------------------------------


@query("index_last_version_wins", _CUSTOMERS)
def index_last_version_wins(spark, sf_dir):
    """One sync over a small older and a large newer version of the same ids."""
    root = scratch(spark)
    t = VersionedTable(spark, f"{root}/source")
    customers = _customers(spark, sf_dir)
    t.overwrite(_old(customers).coalesce(1))
    t.append(customers.coalesce(1))
    idx = Engine(spark, f"{root}/data").create("c", source=f"{root}/source")
    idx.sync()
    return _all(idx, include_gap=False)


@query("gap_last_version_wins", _CUSTOMERS)
def gap_last_version_wins(spark, sf_dir):
    """The same without a sync: all of it is in the gap."""
    root = scratch(spark)
    t = VersionedTable(spark, f"{root}/source")
    customers = _customers(spark, sf_dir)
    t.overwrite(_old(customers).coalesce(1))
    t.append(customers.coalesce(1))
    return _all(Engine(spark, f"{root}/data").create("c", source=f"{root}/source"))


@query("index_files_in_order", _CUSTOMERS)
def index_files_in_order(spark, sf_dir):
    """A small file, then a large one with newer documents of the same ids."""
    root = scratch(spark)
    customers = _customers(spark, sf_dir)
    _old(customers).coalesce(1).write.json(f"{root}/a.ndjson")
    customers.coalesce(1).write.json(f"{root}/b.ndjson")
    idx = Engine(spark, f"{root}/data").create("c", _FIELDS)
    idx.index([f"{root}/a.ndjson", f"{root}/b.ndjson"])
    return _all(idx)


@query("rewritten_rows_keep_their_order", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name, c_acctbal FROM customer WHERE c_acctbal <= 9000")
def rewritten_rows_keep_their_order(spark, sf_dir):
    """Old rows that a delete has written again are still older than what came after them."""
    root = scratch(spark)
    t = VersionedTable(spark, f"{root}/source")
    customers = _customers(spark, sf_dir)
    t.overwrite(customers.withColumn("c_name", F.lit("old")))
    t.append(customers)
    t.delete_where(F.col("c_acctbal") > 9000)
    idx = Engine(spark, f"{root}/data").create("c", source=f"{root}/source")
    idx.sync()
    return _all(idx)


@query("sync_after_vacuum", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0")
def sync_after_vacuum(spark, sf_dir):
    """The source was overwritten and vacuumed since the last sync: all is loaded anew."""
    root = scratch(spark)
    t = VersionedTable(spark, f"{root}/source")
    customers = _customers(spark, sf_dir)
    t.overwrite(customers.withColumn("c_name", F.lit("old")))
    idx = Engine(spark, f"{root}/data").create("c", source=f"{root}/source")
    idx.sync()
    t.overwrite(customers.where("c_acctbal >= 0"))
    t.vacuum()
    idx.sync()
    return _all(idx, include_gap=False)


@query("get_newest_version", "SELECT 'old' AS v, false AS newest WHERE false UNION ALL SELECT c_name, true FROM customer WHERE c_custkey = 42")
def get_newest_version(spark, sf_dir):
    root = scratch(spark)
    t = VersionedTable(spark, f"{root}/source")
    customers = _customers(spark, sf_dir)
    t.overwrite(customers.where("_id = '42'").withColumn("c_name", F.lit("old")))
    t.append(customers)
    doc = Engine(spark, f"{root}/data").create("c", source=f"{root}/source").get("42")
    return spark.createDataFrame([(doc["c_name"], doc["c_name"] != "old")], "v string, newest boolean")


# -- lifecycle, merging, statistics ------------------------------------------


@query("index_reindex_as_of", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name, c_acctbal FROM customer WHERE c_acctbal < 0")
def index_reindex_as_of(spark, sf_dir):
    root = scratch(spark)
    t = VersionedTable(spark, f"{root}/source")
    customers = _customers(spark, sf_dir)
    v = t.overwrite(customers.where("c_acctbal < 0"))
    t.append(customers.where("c_acctbal >= 0"))
    idx = Engine(spark, f"{root}/data").create("c", source=f"{root}/source")
    idx.sync()
    idx.reindex(v)
    return _all(idx, include_gap=False)


@query("index_streaming_sync", _CUSTOMERS)
def index_streaming_sync(spark, sf_dir):
    """A streaming query follows the source's commits."""
    root = scratch(spark)
    t = VersionedTable(spark, f"{root}/source")
    customers = _customers(spark, sf_dir)
    t.overwrite(customers.where("c_acctbal < 0"))
    t.append(customers.where("c_acctbal >= 0"))
    idx = Engine(spark, f"{root}/data").create("c", source=f"{root}/source")
    stream = idx.start_sync(available_now=True)
    stream.awaitTermination()
    return _all(idx, include_gap=False)


@query("index_stats", "SELECT count(*) AS docs, CAST(least(count(*), ceil(count(*) / 1000)) AS BIGINT) AS segments, 0 AS index_version, 0 AS gap FROM customer")
def index_stats(spark, sf_dir):
    root = scratch(spark)
    VersionedTable(spark, f"{root}/source").overwrite(_customers(spark, sf_dir).coalesce(1))
    idx = Engine(spark, f"{root}/data").create("c", source=f"{root}/source")
    idx.sync(segment_size=1000, max_segments=10_000)
    s = idx.stats()
    assert s["compaction"]["segment_size"] == 1000 and s["compaction"]["last_segment_at"] and s["metrics"]["gauge_gap_versions"] == 0
    # the last rows by id go through a shuffle, so segments are counted at least
    return spark.createDataFrame([(s["num_docs"], min(s["num_segments"], -(-s["num_docs"] // 1000)), s["index_version"], s["gap_versions"])], "docs long, segments long, index_version int, gap int")


@query("force_merge_gc", "SELECT 1 AS segments, 1 AS data_folders, 1 AS term_folders, count(*) AS docs FROM documents")
def force_merge_gc(spark, sf_dir):
    """Many segments are merged into one; nothing of the old ones is left."""
    root = scratch(spark)
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), "text", "lang")
    idx = Engine(spark, f"{root}/data").create("d", {"fields": {"text": "text", "lang": "keyword"}})
    for part in ("lang = 'en'", "lang <> 'en' OR lang IS NULL"):
        idx.index(docs.where(part))
    idx.force_merge()
    fs = Files(spark, f"{root}/data/d/index")
    s = idx.stats()
    return spark.createDataFrame([(s["num_segments"], len(fs.names("data")), len(fs.names("terms")), s["num_docs"])], "segments int, data_folders int, term_folders int, docs long")


@query("maybe_merge", _CUSTOMERS)
def maybe_merge(spark, sf_dir):
    """Full levels are merged as a sync goes on; the documents stay the same."""
    root = scratch(spark)
    t = VersionedTable(spark, f"{root}/source")
    customers = _customers(spark, sf_dir)
    idx = Engine(spark, f"{root}/data").create("c", _FIELDS, source=f"{root}/source")
    for lo, hi in ((-10_000, 0), (0, 3000), (3000, 6000), (6000, 1_000_000)):
        t.append(customers.where(f"c_acctbal >= {lo} AND c_acctbal < {hi}"))
        idx.sync(max_segments=2, merge_interval=0.0)
    assert idx.metrics["merges"] > 0 and idx.metrics["merge_seconds_count"] > 0
    return _all(idx)


@query("index_delete", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'")
def index_delete(spark, sf_dir):
    customers = _customers(spark, sf_dir)
    idx = Engine(spark, scratch(spark)).create("c", _FIELDS)
    idx.index(customers)
    idx.delete(customers.where("c_mktsegment = 'BUILDING'").select("_id"))
    return _all(idx)


@query("errors", "SELECT * FROM (VALUES ('create twice', 'IndexExists'), ('drop missing', 'IndexNotFound'), ('dry run', 'SchemaError'), ('get missing', 'DocumentNotFound'), ('lost race', 'WriterLocked'), ('no glob match', 'IngestError'), ('no query', 'QueryParseError'), ('no source', 'TableError'), ('unclosed', 'QueryParseError'), ('unknown field', 'SchemaError')) AS t(what, error)")
def errors(spark, sf_dir):
    """What each kind of misuse raises."""
    root = scratch(spark)
    e = Engine(spark, f"{root}/data")
    idx = e.create("x", {"fields": {"a": "keyword"}})
    idx.index(spark.createDataFrame([("1", "v")], "_id string, a string"))
    cases = {
        "create twice": lambda: e.create("x", {"fields": {}}), "drop missing": lambda: e.drop("y"), "dry run": lambda: e.create("z", dry_run=True), "get missing": lambda: idx.get("2"), "lost race": lambda: idx.table.commit({}, expected=-1),
        "no glob match": lambda: expand(spark, f"{root}/*.zip"), "no query": lambda: idx.search(), "no source": lambda: idx.sync(), "unclosed": lambda: idx.search("(a:v"), "unknown field": lambda: idx.search(dsl={"term": {"b": 1}}),
    }
    kinds = (DocumentNotFound, IndexExists, IndexNotFound, IngestError, QueryParseError, SchemaError, TableError, WriterLocked)
    out = []
    for what, run in cases.items():
        try:
            run()
        except LakefindError as x:
            assert isinstance(x, kinds)
            out.append((what, type(x).__name__))
    return spark.createDataFrame(out, "what string, error string")


@query("index_drop", "SELECT false AS there, CAST('' AS VARCHAR) AS names")
def index_drop(spark, sf_dir):
    e = Engine(spark, scratch(spark))
    e.create("x", {"fields": {"a": "keyword"}})
    e.drop("x")
    return spark.createDataFrame([(e.exists("x"), ",".join(e.list()))], "there boolean, names string")


# -- files, lines, documents -------------------------------------------------


@query("index_ndjson_lenient_lines", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name, c_acctbal FROM customer")
def index_ndjson_lenient_lines(spark, sf_dir):
    """Blank lines and lines that are no JSON object are left out."""
    root = scratch(spark)
    rows = _customers(spark, sf_dir)
    lines = rows.select(F.to_json(F.struct("_id", "c_name", "c_acctbal")).alias("value"))
    junk = rows.select(F.explode(F.array(F.lit(""), F.lit("not json"), F.lit("[1]"), F.concat(F.lit('{"_id":'), "_id"))).alias("value"))
    lines.unionAll(junk).write.text(f"{root}/x.ndjson")
    docs = read_ndjson_documents(spark, [f"{root}/x.ndjson"]).select(F.lit(None).cast("string").alias("_id"), "_source")
    return documents.strict(documents.build(docs, Schema(_FIELDS["fields"]))).select("_id", "c_name", "c_acctbal")


@query("read_lines", "SELECT n_nationkey, n_name, f FROM nation, (VALUES ('csv'), ('json'), ('ndjson')) AS t(f)")
def lines_of_each_format(spark, sf_dir):
    """Standard input in place of a file."""
    rows = [r.asDict() for r in load(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]
    text = {"ndjson": [json.dumps(r) for r in rows], "json": ["[", ",\n".join(json.dumps(r) for r in rows), "]"], "csv": ["n_nationkey,n_name", *(f"{r['n_nationkey']},{r['n_name']}" for r in rows)]}
    parts = [read_lines(spark, x, f).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.lit(f).alias("f")) for f, x in text.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("index_from_lines", "SELECT CAST(n_nationkey AS VARCHAR) AS _id, n_name FROM nation")
def index_from_lines(spark, sf_dir):
    rows = load(spark, sf_dir, "nation").collect()
    lines = [json.dumps({"_id": r["n_nationkey"], "n_name": "old"}) for r in rows] + [json.dumps({"_id": r["n_nationkey"], "n_name": r["n_name"]}) for r in rows]
    idx = Engine(spark, scratch(spark)).create("n", {"fields": {"n_name": "keyword"}})
    idx.index(Lines(lines, "ndjson"))
    return _all(idx, ("n_name",))


@query("ingest_files", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer")
def ingest_files(spark, sf_dir):
    """Globs over files of three formats with different columns, in one commit."""
    root = scratch(spark)
    c = _customers(spark, sf_dir)
    c.where("c_acctbal < 0").select("_id", "c_name").write.csv(f"{root}/in/a.csv", header=True)
    c.where("c_acctbal >= 0 AND c_acctbal < 5000").write.json(f"{root}/in/b.ndjson")
    c.where("c_acctbal >= 5000").write.parquet(f"{root}/in/c.parquet")
    v = ingest(spark, [f"{root}/in/*.csv", f"{root}/in/[bc].*"], f"{root}/table")
    return VersionedTable(spark, f"{root}/table").read(v).select(F.col("_id").cast("string").alias("_id"), "c_name", "c_acctbal")


@query("ingest_newest_last", _CUSTOMERS)
def ingest_newest_last(spark, sf_dir):
    """Files of one ingest have an order too: the last one's documents stay."""
    root = scratch(spark)
    customers = _customers(spark, sf_dir)
    _old(customers).coalesce(1).write.json(f"{root}/a.ndjson")
    customers.coalesce(1).write.parquet(f"{root}/b.parquet")
    ingest(spark, [f"{root}/a.ndjson", f"{root}/b.parquet"], f"{root}/table")
    idx = Engine(spark, f"{root}/data").create("c", source=f"{root}/table")
    idx.sync()
    return _all(idx)


@query("format_detection", "SELECT * FROM (VALUES ('a.NDJSON', 'ndjson'), ('b.jsonl', 'ndjson'), ('c.json', 'json'), ('d.Csv', 'csv'), ('e.parquet', 'parquet'), ('f.txt', NULL)) AS t(path, format)")
def format_detection(spark, sf_dir):
    return spark.createDataFrame([(p, detect_format(p)) for p in ("a.NDJSON", "b.jsonl", "c.json", "d.Csv", "e.parquet", "f.txt")], "path string, format string")


@query("result_sinks", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS json_name, n_name AS table_name FROM nation")
def result_sinks(spark, sf_dir):
    """Hits as one JSON object a line and as a table, read back."""
    idx = Engine(spark, scratch(spark)).create("n", {"fields": {"n_name": "keyword"}})
    idx.index(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_id"), "n_name"))
    hits = sorted(idx.hits("*", limit=1000), key=lambda h: h["_id"])
    lines = [json.loads(x) for x in to_ndjson(hits).splitlines()]
    names, _, *rows = [x.split("\t") for x in to_table(hits).splitlines()]
    return spark.createDataFrame([(a["_id"], a["n_name"], b[names.index("n_name")]) for a, b in zip(lines, rows)], "id string, json_name string, table_name string")


@query("lenient_documents", "SELECT o_orderstatus AS status, count(*) AS bad FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def lenient_documents(spark, sf_dir):
    """Documents whose value does not fit their field are set apart; here those of all orders but the filled ones."""
    o = load(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderstatus") == "F", F.to_json(F.struct(F.col("o_totalprice").alias("p")))).otherwise(F.to_json(F.struct(F.col("o_totalprice").cast("string").alias("p"))))
    docs = o.select(F.col("o_orderkey").cast("string").alias("_id"), price.alias("_source"), "o_orderstatus")
    good, bad = documents.lenient(documents.build(docs, Schema({"p": "numeric"})))
    assert good.count() > 0
    return bad.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("bad"))


@query("made_up_ids", "SELECT count(*) AS n, count(*) AS distinct_ids, true AS uuids FROM nation")
def made_up_ids(spark, sf_dir):
    idx = Engine(spark, scratch(spark)).create("n", {"fields": {"n_name": "keyword"}})
    idx.index(load(spark, sf_dir, "nation").select("n_name"))
    return _all(idx, ("n_name",)).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_id").alias("distinct_ids"), F.bool_and(F.col("_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("uuids"))


@query("projection_top_level", "SELECT CAST(event_id AS VARCHAR) AS _id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE event_type = 'error'")
def projection_top_level(spark, sf_dir):
    """A nested object comes whole under its top-level name."""
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), "event_type", F.from_json("props", "k double").alias("props"))
    idx = Engine(spark, scratch(spark)).create("e", {"fields": {"event_type": "keyword", "props.k": "numeric"}})
    idx.index(e)
    return idx.search("event_type:error", limit=None, fields=["props"]).select("_id", F.col("`props.k`").alias("k"))


# -- query strings, scores, paging -------------------------------------------

_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


@query("qs_dotted_field", f"SELECT event_id AS _id FROM events WHERE {_K} >= 90 AND event_type = 'click'")
def qs_dotted_field(spark, sf_dir):
    return searching.search(corpus(spark, sf_dir, "events"), "+props.k:>=90 +event_type:click", limit=None, fields=[])


@query("qs_slop", f"SELECT DISTINCT _id FROM (SELECT _id, w, unnest(range(1, len(w) + 1)) AS i FROM {_DOCS}) WHERE w[i] = 'the' AND (list_position(w[i + 1:i + 3], 'of') > 0)")
def qs_slop(spark, sf_dir):
    return searching.search(corpus(spark, sf_dir, "documents"), 'text:"the of"~2', limit=None, fields=[])


@query("qs_boost", _BM25.replace("sum(x) AS s", "sum(CASE WHEN t = 'that' THEN 3 * x ELSE x END) AS s").replace("SELECT _id, lang, ln(", "SELECT _id, lang, t, ln(") + "20")
def qs_boost(spark, sf_dir):
    return searching.search(corpus(spark, sf_dir, "documents"), "text:that^3 text:and", fields=["lang"], limit=20, score=True).withColumn("_score", F.round("_score", 6))


@query("search_filter_scores_nothing", _BM25.replace("FROM r ORDER", "FROM r WHERE lang = 'en' ORDER") + "20")
def search_filter_scores_nothing(spark, sf_dir):
    dsl = {"bool": {"must": {"match": {"text": "that and"}}, "filter": {"term": {"lang": "en"}}}}
    return searching.search(corpus(spark, sf_dir, "documents"), dsl=dsl, fields=["lang"], limit=20, score=True).withColumn("_score", F.round("_score", 6))


@query("search_defaults", f"SELECT _id, lang FROM ({_BM25}20)")
def search_defaults(spark, sf_dir):
    """Twenty hits from the first, without scores."""
    return searching.search(corpus(spark, sf_dir, "documents"), "text:that text:and", fields=["lang"])


@query("search_limit_zero", "SELECT o_orderkey AS _id, o_totalprice FROM orders WHERE false")
def search_limit_zero(spark, sf_dir):
    """Nothing is asked for, so a sort by no such field is no error."""
    return searching.search(corpus(spark, sf_dir, "orders"), "*", limit=0, sort="nope", fields=["o_totalprice"])


@query("search_sorted_scores_zero", "SELECT o_orderkey AS _id, 0.0::DOUBLE AS _score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def search_sorted_scores_zero(spark, sf_dir):
    return searching.search(corpus(spark, sf_dir, "orders"), "o_orderstatus:O *", limit=5, sort="o_totalprice", fields=[], score=True)


_HOSTS = "(SELECT c_custkey AS _id, '10.' || (c_custkey // 65536) || '.' || (c_custkey // 256 % 256) || '.' || (c_custkey % 256) AS host, c_mktsegment FROM customer)"


def _hosts(spark, sf_dir):
    k = F.col("c_custkey")
    part = lambda n: F.pmod(F.floor(k / n), F.lit(256)).cast("string")
    return load(spark, sf_dir, "customer").select(k.alias("_id"), F.concat_ws(".", F.lit("10"), part(65536), part(256), part(1)).alias("host"), "c_mktsegment")


@query("dsl_term_ip", f"SELECT _id, host FROM {_HOSTS} WHERE host IN ('10.0.0.77', '10.0.1.2')")
def dsl_term_ip(spark, sf_dir):
    """IPv4 and its IPv6 form are one address."""
    c = Corpus(_hosts(spark, sf_dir), Schema({"host": "ip", "c_mktsegment": "keyword"}))
    return searching.search(c, dsl={"terms": {"host": ["::ffff:10.0.0.77", "10.0.1.2"]}}, limit=None, fields=["host"])


@query("ip_keys", f"SELECT _id, '00000000000000000000ffff' || printf('%08x', 10 * 16777216 + _id) AS k FROM {_HOSTS}")
def ip_keys(spark, sf_dir):
    return _hosts(spark, sf_dir).select("_id", ip_key("host").alias("k"))


_STEMS = {
    "running": "run", "runs": "run", "fasting": "fast", "diabetic": "diabet", "diabetes": "diabet", "caresses": "caress", "flies": "fli", "dies": "die", "agreed": "agre", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam",
    "operator": "oper", "feudalism": "feudal", "hopefulness": "hope", "formality": "formal", "sensitivity": "sensit", "triplicate": "triplic", "electrical": "electr", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "probate": "probat", "controlling": "control",
    "skies": "sky", "dying": "die", "news": "news", "generously": "generous", "knightly": "knight", "consign": "consign", "consisting": "consist", "kindness": "kind", "knack": "knack",
}


@query("stems", "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in _STEMS.items()) + ") AS t(word, stem)")
def stems(spark, sf_dir):
    """Words and their stems as the published vocabulary of the stemmer has them, by the column function."""
    from .functions import analysis

    words = spark.createDataFrame([(w,) for w in _STEMS], "word string")
    return words.select("word", F.element_at(analysis.tokens(F.col("word"), "en_stem"), 1).alias("stem"))


@query("analyzers", "SELECT * FROM (VALUES ('raw', 'The Fast-ing'), ('simple', 'the fast ing'), ('en_stem', 'the fast ing'), ('wildcard', '^(?s:a.*b.\\*)\\z'), ('ip', '00000000000000000000000000000001')) AS t(what, result)")
def analyzers(spark, sf_dir):
    out = [(a, " ".join(analyze("The Fast-ing", a))) for a in ("raw", "simple", "en_stem")]
    return spark.createDataFrame([*out, ("wildcard", wildcard_regex("a*b?\\*")), ("ip", parse_ip("::1"))], "what string, result string")


# -- aggregations as they are rendered, sketches, top hits -------------------


@query("agg_rendered", """SELECT p AS "by", n AS doc_count, s AS "inner", m, c FROM (
SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS c, round(avg(o_totalprice), 4) AS m, sum(count(*)) OVER (PARTITION BY o_orderpriority)::BIGINT AS n,
row_number() OVER (PARTITION BY o_orderpriority ORDER BY avg(o_totalprice), o_orderstatus) AS r FROM orders GROUP BY 1, 2)
WHERE r <= 2 AND p IN (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)""")
def agg_rendered(spark, sf_dir):
    """Size and order of nested buckets, as the rendered result has them."""
    got = aggregations.aggregate(corpus(spark, sf_dir, "orders"), {"by": {"terms": {"field": "o_orderpriority", "size": 3}, "aggs": {"inner": {"terms": {"field": "o_orderstatus", "size": 2, "order": {"m": "asc"}}, "aggs": {"m": {"avg": {"field": "o_totalprice"}}}}}}})
    rows = [(b["key"], b["doc_count"], i["key"], round(i["m"]["value"], 4), i["doc_count"]) for b in got["by"]["buckets"] for i in b["inner"]["buckets"]]
    return spark.createDataFrame(rows, "by string, doc_count long, inner string, m double, c long")


@query("agg_empty_buckets", "WITH h AS (SELECT floor(p_retailprice / 1) * 1.0 AS k, count(*) AS n FROM part GROUP BY 1) SELECT x::DOUBLE AS by, coalesce(n, 0)::BIGINT AS doc_count FROM (SELECT unnest(range((SELECT min(k) FROM h)::BIGINT, (SELECT max(k) FROM h)::BIGINT + 1)) AS x) LEFT JOIN h ON k = x")
def agg_empty_buckets(spark, sf_dir):
    """A histogram fills in the buckets between that nothing is in."""
    got = aggregations.aggregate(corpus(spark, sf_dir, "part"), {"by": {"histogram": {"field": "p_retailprice", "interval": 1}}})
    return spark.createDataFrame([(float(b["key"]), b["doc_count"]) for b in got["by"]["buckets"]], "by double, doc_count long")


@query("agg_percentiles_sketch", "SELECT unnest([1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0]::DOUBLE[]) AS pct, true AS near")
def agg_percentiles_sketch(spark, sf_dir):
    """The sketch is within one hundredth of the rank asked for."""
    c = corpus(spark, sf_dir, "orders")
    got = aggregations.aggregate(c, {"m": {"percentiles": {"field": "o_totalprice"}}})["m"]["values"]
    ranks = c.df.agg(F.count("o_totalprice").alias("n"), *[F.count_if(F.col("o_totalprice") <= v).alias(p) for p, v in got.items()]).first()
    return spark.createDataFrame([(float(p), abs(ranks[p] / ranks["n"] - float(p) / 100) <= 0.01) for p in got], "pct double, near boolean")


@query("agg_cardinality_sketch", "SELECT 'o_custkey' AS field, true AS near")
def agg_cardinality_sketch(spark, sf_dir):
    """The sketch is within a tenth of the exact number."""
    c = corpus(spark, sf_dir, "orders")
    sketch, exact = (aggregations.aggregate(c, {"m": {"cardinality": {"field": "o_custkey"}}}, exact=x)["m"]["value"] for x in (False, True))
    return spark.createDataFrame([("o_custkey", abs(sketch - exact) <= 0.1 * exact)], "field string, near boolean")


@query("agg_top_hits", "SELECT * FROM (SELECT o_orderpriority AS by, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank, o_orderkey AS _id, o_totalprice FROM orders) WHERE rank <= 3")
def agg_top_hits(spark, sf_dir):
    request = {"by": {"terms": {"field": "o_orderpriority"}, "aggs": {"best": {"top_hits": {"size": 3, "sort": [{"o_totalprice": {"order": "desc"}}], "_source": ["o_totalprice"]}}}}}
    return aggregations.top_hits(corpus(spark, sf_dir, "orders"), request, ["by"], "best")


@query("agg_missing", "SELECT coalesce(l.quality, -1)::DOUBLE AS \"by\", count(*) AS doc_count, sum(coalesce(l.toxic, 5))::DOUBLE AS s FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def agg_missing(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    c = Corpus(docs, Schema({"quality": "numeric", "toxic": "numeric"}), "doc_id")
    got = aggregations.frame(c, {"by": {"terms": {"field": "quality", "missing": -1}, "aggs": {"s": {"sum": {"field": "toxic", "missing": 5}}}}}, ["by"])
    return got.select(F.col("by").cast("double").alias("by"), "doc_count", "s")

