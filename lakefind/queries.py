"""The registered queries of the search engine over the test tables, each with its SQL for DuckDB.

Every query runs over its whole table.  A limit is there only where it is the
feature (top-k and paging).
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregations, documents, mutate
from .operators import search as searching
from .plans.compile import Corpus
from .schema import Schema, infer_json, infer_struct
from .sources.files import Files
from .sources.ingest import read_file
from .sources.table import VersionedTable

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Schema and id of each table that is searched in place.
CORPORA: dict[str, tuple[str, dict[str, str]]] = {
    "documents": ("doc_id", {"text": "text", "lang": "keyword", "source": "keyword", "n_chars": "numeric"}),
    "events": ("event_id", {"ts": "date", "event_type": "keyword", "user_id": "numeric", "value": "numeric", "props.k": "numeric"}),
    "orders": ("o_orderkey", {"o_custkey": "numeric", "o_orderstatus": "keyword", "o_totalprice": "numeric", "o_orderdate": "date", "o_orderpriority": "keyword"}),
    "lineitem": ("l_orderkey", {"l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_returnflag": "keyword", "l_linestatus": "keyword", "l_shipdate": "date"}),
    "part": ("p_partkey", {"p_name": "text", "p_brand": "keyword", "p_type": "keyword", "p_size": "numeric", "p_retailprice": "numeric"}),
    "customer": ("c_custkey", {"c_name": "keyword", "c_nationkey": "numeric", "c_acctbal": "numeric", "c_mktsegment": "keyword"}),
    "pages": ("page_id", {"url": "keyword", "html": "text"}),
    "conversations": ("conv_id", {"role": "keyword", "text": "text", "turn": "numeric"}),
    "nation": ("n_nationkey", {"n_name": "keyword", "n_regionkey": "numeric"}),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, name: str, analyzer: str = "simple") -> Corpus:
    """A test table as a searchable corpus."""
    ident, fields = CORPORA[name]
    df = load(spark, sf_dir, name)
    extra = {"props.k": F.get_json_object("props", "$.k").cast("double")} if name == "events" else {}
    return Corpus(df, Schema(dict(fields)), ident, analyzer, extra)


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _search(name: str, table: str, sql: str | None, cols: list[str], analyzer: str = "simple", **options) -> None:
    """A query that returns the ids, and the columns named, of what matches."""

    def run(spark, sf_dir):
        c = corpus(spark, sf_dir, table, analyzer)
        out = searching.search(c, fields=cols, **({"limit": None} | options))
        if "_score" in out.columns:
            out = out.withColumn("_score", F.round("_score", 6))
        return out

    query(name, sql)(run)


T = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')".format
_DOCS = f"(SELECT doc_id AS _id, lang, source, n_chars, list_filter({T('text')}, lambda x: len(x) <= 40) AS w FROM documents)"
_PARTS = f"(SELECT p_partkey AS _id, p_name, p_brand, p_type, p_size, {T('p_name')} AS w FROM part)"

# -- the JSON query language -------------------------------------------------

_search("dsl_match_all", "nation", "SELECT n_nationkey AS _id, n_name FROM nation", ["n_name"], dsl={"match_all": {}})
_search("dsl_match_none", "nation", "SELECT n_nationkey AS _id, n_name FROM nation WHERE false", ["n_name"], dsl={"match_none": {}})
_search("dsl_term_keyword", "events", "SELECT event_id AS _id, event_type FROM events WHERE event_type = 'click'", ["event_type"], dsl={"term": {"event_type": "click"}})
_search("dsl_term_numeric", "customer", "SELECT c_custkey AS _id, c_name FROM customer WHERE c_nationkey = 7", ["c_name"], dsl={"term": {"c_nationkey": {"value": 7}}})
_search("dsl_term_date", "orders", "SELECT o_orderkey AS _id, o_orderstatus FROM orders WHERE o_orderdate = TIMESTAMP '1997-05-28'", ["o_orderstatus"], dsl={"term": {"o_orderdate": "1997-05-28"}})
_search("dsl_term_token", "documents", f"SELECT _id FROM {_DOCS} WHERE list_contains(w, 'and')", [], dsl={"term": {"text": "and"}})
_search("dsl_terms", "orders", "SELECT o_orderkey AS _id, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", ["o_orderpriority"], dsl={"terms": {"o_orderpriority": ["1-URGENT", "2-HIGH"]}})
_search("dsl_terms_numeric", "part", "SELECT p_partkey AS _id, p_name FROM part WHERE p_size IN (1, 7, 49)", ["p_name"], dsl={"terms": {"p_size": [1, 7, 49]}})
_search("dsl_match_or", "documents", f"SELECT _id, lang FROM {_DOCS} WHERE list_has_any(w, ['that', 'und'])", ["lang"], dsl={"match": {"text": "That, und!"}})
_search("dsl_match_and", "documents", f"SELECT _id, lang FROM {_DOCS} WHERE list_has_all(w, ['that', 'and'])", ["lang"], dsl={"match": {"text": {"query": "that and", "operator": "and"}}})
_search("dsl_match_keyword", "customer", "SELECT c_custkey AS _id, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY'", ["c_mktsegment"], dsl={"match": {"c_mktsegment": "MACHINERY"}})
_search("dsl_match_phrase", "documents", f"SELECT _id FROM {_DOCS} WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')", [], dsl={"match_phrase": {"text": "Of the"}})
_SLOP = """SELECT DISTINCT _id FROM (SELECT _id, w, unnest(range(1, len(w) + 1)) AS i FROM {docs}) WHERE w[i] = 'the' AND (list_position(w[i + 1:i + 3], 'of') > 0)"""
_search("dsl_match_phrase_slop", "documents", _SLOP.format(docs=_DOCS), [], dsl={"match_phrase": {"text": {"query": "the of", "slop": 2}}})
_search("dsl_multi_match", "part", f"SELECT _id, p_name, p_type FROM {_PARTS} WHERE p_type = 'ECONOMY' OR list_contains(w, 'economy')", ["p_name", "p_type"], dsl={"multi_match": {"query": "ECONOMY", "fields": ["p_name", "p_type"]}})
_search("dsl_range_numeric", "lineitem", "SELECT l_orderkey AS _id, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_quantity < 48", ["l_quantity"], dsl={"range": {"l_quantity": {"gte": 45, "lt": 48}}})
_search("dsl_range_date", "events", "SELECT event_id AS _id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-10 12:00:00' AND ts <= TIMESTAMP '2024-01-12 00:00:00'", ["event_type"], dsl={"range": {"ts": {"gt": "2024-01-10T12:00:00Z", "lte": "2024-01-12"}}})
_search("dsl_range_open", "orders", "SELECT o_orderkey AS _id, o_totalprice FROM orders WHERE o_totalprice > 400000", ["o_totalprice"], dsl={"range": {"o_totalprice": {"gt": 400000}}})
_search("dsl_prefix_keyword", "pages", "SELECT page_id AS _id, url FROM pages WHERE starts_with(url, 'http://th')", ["url"], dsl={"prefix": {"url": "http://th"}})
_search("dsl_prefix_text", "part", f"SELECT _id, p_name FROM {_PARTS} WHERE contains(' ' || array_to_string(w, ' '), ' small ri')", ["p_name"], dsl={"prefix": {"p_name": {"value": "small ri"}}})
_search("dsl_wildcard", "part", r"SELECT p_partkey AS _id, p_brand FROM part WHERE regexp_full_match(p_brand, 'Brand#.[0-9]*7')", ["p_brand"], dsl={"wildcard": {"p_brand": "Brand#?*7"}})
_search("dsl_wildcard_text", "part", f"SELECT _id, p_name FROM {_PARTS} WHERE len(list_filter(w, lambda x: regexp_full_match(x, 'w.d.*t'))) > 0", ["p_name"], dsl={"wildcard": {"p_name": "w?d*t"}})
_search("dsl_bool", "documents", f"SELECT _id, lang, n_chars FROM {_DOCS} WHERE list_contains(w, 'the') AND lang = 'en' AND n_chars >= 500 AND NOT list_contains(w, 'that')", ["lang", "n_chars"], dsl={"bool": {"must": {"match": {"text": "the"}}, "filter": [{"term": {"lang": "en"}}, {"range": {"n_chars": {"gte": 500}}}], "must_not": {"match": {"text": "that"}}}})
_search("dsl_bool_must_not", "orders", "SELECT o_orderkey AS _id, o_orderstatus FROM orders WHERE coalesce(o_orderstatus, '') <> 'F'", ["o_orderstatus"], dsl={"bool": {"must_not": {"term": {"o_orderstatus": "F"}}}})
_search("dsl_bool_should", "orders", "SELECT o_orderkey AS _id FROM orders WHERE o_orderstatus = 'P' OR o_totalprice < 2000", [], dsl={"bool": {"should": [{"term": {"o_orderstatus": "P"}}, {"range": {"o_totalprice": {"lt": 2000}}}]}})
_search("dsl_bool_must_should", "orders", "SELECT o_orderkey AS _id FROM orders WHERE o_orderstatus = 'P'", [], dsl={"bool": {"must": {"term": {"o_orderstatus": "P"}}, "should": {"range": {"o_totalprice": {"lt": 2000}}}}})
_search("dsl_bool_nested", "orders", "SELECT o_orderkey AS _id FROM orders WHERE (o_orderstatus = 'P' OR o_orderpriority = '5-LOW') AND NOT (o_totalprice > 100000 AND o_orderstatus = 'P')", [], dsl={"bool": {"must": {"bool": {"should": [{"term": {"o_orderstatus": "P"}}, {"term": {"o_orderpriority": "5-LOW"}}]}}, "must_not": {"bool": {"must": [{"range": {"o_totalprice": {"gt": 100000}}}, {"term": {"o_orderstatus": "P"}}]}}}})
_search("json_nested_path", "events", "SELECT event_id AS _id, props FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 90", ["props"], dsl={"range": {"props.k": {"gte": 90}}})


def _labelled(spark: SparkSession, sf_dir: str) -> Corpus:
    """Documents with their labels as fields that most lack."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return Corpus(docs, Schema({"lang": "keyword", "quality": "numeric", "toxic": "numeric"}), "doc_id")


_LEFT = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@query("dsl_exists", f"SELECT d.doc_id AS _id, l.quality FROM {_LEFT} WHERE l.quality IS NOT NULL")
def dsl_exists(spark, sf_dir):
    return searching.search(_labelled(spark, sf_dir), dsl={"exists": {"field": "quality"}}, limit=None, fields=["quality"])


@query("dsl_bool_must_not_null", f"SELECT d.doc_id AS _id, l.quality FROM {_LEFT} WHERE NOT coalesce(l.quality = 1, false) AND NOT coalesce(l.toxic >= 1, false)")
def dsl_bool_must_not_null(spark, sf_dir):
    return searching.search(_labelled(spark, sf_dir), dsl={"bool": {"must_not": [{"term": {"quality": 1}}, {"range": {"toxic": {"gte": 1}}}]}}, limit=None, fields=["quality"])


@query("array_field_any", f"SELECT _id FROM {_DOCS} WHERE list_contains(w, 'la') AND NOT list_contains(w, 'le')")
def array_field_any(spark, sf_dir):
    from .functions.analysis import simple_tokens

    docs = load(spark, sf_dir, "documents").select("doc_id", simple_tokens(F.col("text")).alias("words"))
    c = Corpus(docs, Schema({"words": "keyword"}), "doc_id")
    return searching.search(c, dsl={"bool": {"must": {"term": {"words": "la"}}, "must_not": {"term": {"words": "le"}}}}, limit=None, fields=[])


@query("array_field_range", "SELECT vec_id AS _id, label FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.3 AND x < 0.35)) > 0")
def array_field_range(spark, sf_dir):
    c = Corpus(load(spark, sf_dir, "embeddings"), Schema({"embedding": "numeric", "label": "numeric"}), "vec_id")
    return searching.search(c, dsl={"range": {"embedding": {"gt": 0.3, "lt": 0.35}}}, limit=None, fields=["label"])


# -- query strings -----------------------------------------------------------

_search("qs_term", "documents", f"SELECT _id, lang FROM {_DOCS} WHERE list_contains(w, 'en') OR lang = 'en' OR source = 'en'", ["lang"], query="en")
_search("qs_field", "documents", f"SELECT _id FROM {_DOCS} WHERE list_contains(w, 'une')", [], query="text:une")
_search("qs_plus_minus", "orders", "SELECT o_orderkey AS _id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'", [], query='+o_orderstatus:O -o_orderpriority:"5-LOW"')
_search("qs_range", "orders", "SELECT o_orderkey AS _id FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 20000 AND o_orderdate > TIMESTAMP '1997-01-01'", [], query="+o_totalprice:[1000 TO 20000} +o_orderdate:{1997-01-01 TO *]")
_search("qs_compare", "part", "SELECT p_partkey AS _id FROM part WHERE p_size >= 48 OR p_size < 2", [], query="p_size:>=48 OR p_size:<2")
_search("qs_phrase", "documents", f"SELECT _id FROM {_DOCS} WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' in the ')", [], query='text:"in the"')
_search("qs_phrase_prefix", "documents", f"SELECT _id FROM {_DOCS} WHERE contains(' ' || array_to_string(w, ' '), ' in th')", [], query='text:"in th"*')
_search("qs_and_filter", "documents", f"SELECT _id FROM {_DOCS} WHERE list_has_any(w, ['the', 'der']) AND lang = 'de' AND n_chars > 300", [], query="text:the text:der", filter="lang:de AND n_chars:>300")
_search("qs_precedence", "orders", "SELECT o_orderkey AS _id FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_totalprice > 400000)", [], query="o_orderstatus:P OR o_orderstatus:F AND o_totalprice:>400000")
_search("qs_not", "orders", "SELECT o_orderkey AS _id FROM orders WHERE NOT (o_orderstatus = 'P' OR o_orderstatus = 'O')", [], query="NOT (o_orderstatus:P o_orderstatus:O)")
_search("qs_set", "events", "SELECT event_id AS _id FROM events WHERE event_type IN ('click', 'error')", [], query="event_type:IN [click error]")
_search("qs_all", "nation", "SELECT n_nationkey AS _id FROM nation", [], query="__present__:__all__")


@query("qs_present", f"SELECT d.doc_id AS _id FROM {_LEFT} WHERE l.toxic IS NOT NULL AND d.lang = 'en'")
def qs_present(spark, sf_dir):
    return searching.search(_labelled(spark, sf_dir), "+__present__:toxic +lang:en", limit=None, fields=[])


# -- ranking, sorting, paging ------------------------------------------------

_TERMS = "'that', 'and'"
_BM25 = f"""
WITH d AS (SELECT doc_id AS _id, lang, list_filter({T('text')}, lambda x: len(x) <= 40) AS w FROM documents),
s AS (SELECT count(*) AS n, sum(coalesce(len(w), 0)) / count(*) AS avg_len FROM d),
q AS (SELECT unnest([{_TERMS}]) AS t),
f AS (SELECT t, count_if(list_contains(w, t)) AS df FROM d, q GROUP BY t),
p AS (SELECT _id, lang, ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg_len)) AS x
      FROM (SELECT _id, lang, w, t, len(list_filter(w, lambda y: y = t)) AS tf FROM d, q) JOIN f USING (t), s WHERE tf > 0),
r AS (SELECT _id, lang, sum(x) AS s FROM p GROUP BY _id, lang)
SELECT _id, lang, round(s, 6) AS _score FROM r ORDER BY s DESC, _id LIMIT """
_search("search_bm25_topk", "documents", _BM25 + "20", ["lang"], query="text:that text:and", limit=20, score=True)
_search("search_bm25_offset", "documents", _BM25 + "10 OFFSET 15", ["lang"], dsl={"match": {"text": "that and"}}, limit=10, offset=15, score=True)
_search("search_sort_desc", "orders", "SELECT o_orderkey AS _id, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25", ["o_totalprice"], dsl={"match_all": {}}, sort="o_totalprice:desc", limit=25)
_search("search_sort_asc", "events", "SELECT event_id AS _id, value FROM events WHERE event_type = 'view' ORDER BY value ASC NULLS LAST, event_id LIMIT 25", ["value"], query="event_type:view", sort="value:asc", limit=25)
_search("search_sort_date_offset", "orders", "SELECT o_orderkey AS _id, o_orderpriority FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 30", ["o_orderpriority"], query="o_orderstatus:F", sort="o_orderdate", limit=10, offset=30)
_search("search_projection", "customer", "SELECT c_custkey AS _id, c_name, c_acctbal FROM customer WHERE c_acctbal < 0", ["c_acctbal", "c_name", "unknown"], query="c_acctbal:<0")


@query("search_sort_missing_last", f"SELECT d.doc_id AS _id, l.quality FROM {_LEFT} ORDER BY l.quality ASC NULLS LAST, d.doc_id LIMIT 50 OFFSET 300")
def search_sort_missing_last(spark, sf_dir):
    return searching.search(_labelled(spark, sf_dir), "*", sort="quality:asc", limit=50, offset=300, fields=["quality"])


@query("get_by_id", "SELECT c_custkey AS _id, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def get_by_id(spark, sf_dir):
    return searching.get(corpus(spark, sf_dir, "customer"), "42", ["c_name", "c_mktsegment"])


# the forms of two stems that the documents have
_FORMS = "eranlyed eranator eraneant eraneation eranerly eranered eran eraning eranes eranering eraned eraneable eranly eranated eranlying eranates eranating eraningly eraner onanered onanlyed onanes onan onaned onanates onanment onanering onanated onanator onanerly onaning onanating onaneable onaneant onaner onaneation onanly onanedly"
_SEARCHED = ", ".join(f"'{w}'" for w in _FORMS.split())
_search("search_stemmed", "documents", f"SELECT _id, lang FROM {_DOCS} WHERE list_has_any(w, [{_SEARCHED}])", ["lang"], "en_stem", query="text:eraning OR text:onanly")


# -- aggregations ------------------------------------------------------------


def _agg(name: str, table: str, sql: str, request: dict, path: list[str] | None = None, **where) -> None:
    def run(spark, sf_dir):
        c = corpus(spark, sf_dir, table)
        cond = searching.matching(c, searching.query_tree(c.schema, **where)) if where else None
        out = aggregations.frame(c, request, path, where=cond, exact=True)
        # parts of a metric get plain names, doubles a fixed number of places
        out = out.toDF(*[x.replace(".", "_") for x in out.columns])
        return out.select(*[F.round(x, 4).alias(x) if t == "double" else F.col(x) for x, t in out.dtypes])

    query(name, sql)(run)


_agg("agg_terms", "orders", "SELECT o_orderpriority AS by, count(*) AS doc_count FROM orders GROUP BY 1", {"by": {"terms": {"field": "o_orderpriority"}}}, ["by"])
_RANGES = "(VALUES ('*-20', NULL, 20), ('10-30', 10, 30), ('30-*', 30, NULL)) AS r(\"by\", lo, hi)"
_agg("agg_range", "lineitem", f"SELECT \"by\", count(*) AS doc_count FROM lineitem, {_RANGES} WHERE (lo IS NULL OR l_quantity >= lo) AND (hi IS NULL OR l_quantity < hi) GROUP BY 1", {"by": {"range": {"field": "l_quantity", "ranges": [{"to": 20}, {"from": 10, "to": 30}, {"from": 30}]}}}, ["by"])
_agg("agg_histogram", "lineitem", "SELECT floor((l_extendedprice - 500) / 10000) * 10000 + 500 AS by, count(*) AS doc_count FROM lineitem GROUP BY 1", {"by": {"histogram": {"field": "l_extendedprice", "interval": 10000, "offset": 500}}}, ["by"])
_agg("agg_date_histogram", "events", "SELECT epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) AS by, count(*) AS doc_count FROM events GROUP BY 1", {"by": {"date_histogram": {"field": "ts", "fixed_interval": "1d"}}}, ["by"])
_agg("agg_avg", "lineitem", "SELECT count(*) AS doc_count, round(avg(l_discount), 4) AS m FROM lineitem", {"m": {"avg": {"field": "l_discount"}}})
_agg("agg_sum", "orders", "SELECT count(*) AS doc_count, round(sum(o_totalprice), 4) AS m FROM orders WHERE o_orderstatus = 'F'", {"m": {"sum": {"field": "o_totalprice"}}}, query="o_orderstatus:F")
_agg("agg_min_max", "lineitem", "SELECT l_returnflag AS by, count(*) AS doc_count, round(min(l_extendedprice), 4) AS lo, round(max(l_extendedprice), 4) AS hi FROM lineitem GROUP BY 1", {"by": {"terms": {"field": "l_returnflag"}, "aggs": {"lo": {"min": {"field": "l_extendedprice"}}, "hi": {"max": {"field": "l_extendedprice"}}}}}, ["by"])
_agg("agg_value_count", "events", "SELECT count(*) AS doc_count, count(event_type) AS m FROM events", {"m": {"value_count": {"field": "event_type"}}})
_agg("agg_stats", "lineitem", "SELECT count(*) AS doc_count, count(l_quantity) AS m_count, min(l_quantity) AS m_min, max(l_quantity) AS m_max, round(sum(l_quantity), 4) AS m_sum, round(avg(l_quantity), 4) AS m_avg FROM lineitem", {"m": {"stats": {"field": "l_quantity"}}})
_agg("agg_extended_stats", "part", "SELECT count(*) AS doc_count, count(p_size) AS m_count, min(p_size)::DOUBLE AS m_min, max(p_size)::DOUBLE AS m_max, sum(p_size)::DOUBLE AS m_sum, round(avg(p_size), 4) AS m_avg, round(var_pop(p_size), 4) AS m_variance, round(stddev_pop(p_size), 4) AS m_std_deviation FROM part", {"m": {"extended_stats": {"field": "p_size"}}})
_agg("agg_cardinality", "orders", "SELECT o_orderstatus AS by, count(*) AS doc_count, count(DISTINCT o_custkey) AS m FROM orders GROUP BY 1", {"by": {"terms": {"field": "o_orderstatus"}, "aggs": {"m": {"cardinality": {"field": "o_custkey"}}}}}, ["by"])
_agg("agg_terms_sub_avg", "orders", "SELECT o_orderpriority AS by, o_orderstatus AS inner, count(*) AS doc_count, round(avg(o_totalprice), 4) AS m FROM orders GROUP BY 1, 2", {"by": {"terms": {"field": "o_orderpriority"}, "aggs": {"inner": {"terms": {"field": "o_orderstatus"}, "aggs": {"m": {"avg": {"field": "o_totalprice"}}}}}}}, ["by", "inner"])
_agg("agg_filtered", "events", "SELECT event_type AS by, count(*) AS doc_count, round(avg(value), 4) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND value > 10 GROUP BY 1", {"by": {"terms": {"field": "event_type"}, "aggs": {"m": {"avg": {"field": "value"}}}}}, ["by"], query="+ts:[2024-01-15 TO *] +value:>10")


@query("agg_percentiles", "SELECT unnest([25.0, 50.0, 99.0]::DOUBLE[]) AS pct, round(unnest(quantile_cont(o_totalprice, [0.25, 0.5, 0.99])), 4) AS value FROM orders")
def agg_percentiles(spark, sf_dir):
    got = aggregations.frame(corpus(spark, sf_dir, "orders"), {"m": {"percentiles": {"field": "o_totalprice", "percents": [25, 50, 99]}}}, exact=True)
    percents = F.array(*[F.lit(x) for x in (25.0, 50.0, 99.0)])
    return got.select(F.explode(F.arrays_zip(percents.alias("pct"), F.col("`m.values`").alias("value"))).alias("x")).select(F.col("x.pct").alias("pct"), F.round("x.value", 4).alias("value"))


@query("agg_array_terms", f"SELECT t AS by, count(*) AS doc_count FROM (SELECT _id, unnest(list_distinct(w)) AS t FROM {_DOCS}) GROUP BY 1")
def agg_array_terms(spark, sf_dir):
    from .functions.analysis import simple_tokens

    docs = load(spark, sf_dir, "documents").select("doc_id", simple_tokens(F.col("text")).alias("words"))
    return aggregations.frame(Corpus(docs, Schema({"words": "keyword"}), "doc_id"), {"by": {"terms": {"field": "words"}}}, ["by"])


# -- upsert, two tiers, versions ---------------------------------------------


@query("upsert_last_wins", "SELECT user_id AS _id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_last_wins(spark, sf_dir):
    """All events as upserts of their user: the last one stays."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("_id"), "event_type", "value", "event_id")
    return mutate.last_wins(e, seq="event_id").drop("event_id")


@query("delete_by_id", "SELECT o_orderkey AS _id, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def delete_by_id(spark, sf_dir):
    base = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_id"), "o_totalprice")
    return mutate.delete(base, load(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("_id")))


def _tiers(spark: SparkSession, sf_dir: str) -> Corpus:
    """Orders as the base; those of status P come again in the gap, urgent and with a new price; those of status F go."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_id"), "o_orderstatus", "o_totalprice", "o_orderpriority")
    gap = orders.where("o_orderstatus = 'P'").withColumn("o_totalprice", F.col("o_totalprice") * 2).withColumn("o_orderpriority", F.lit("1-URGENT"))
    gone = orders.where("o_orderstatus = 'F'").select("_id")
    return Corpus(searching.merged(orders, gap, gone, tier="tier"), Schema({"o_orderstatus": "keyword", "o_totalprice": "numeric", "o_orderpriority": "keyword"}))


_TIERS = """(SELECT o_orderkey AS _id, o_orderpriority, o_totalprice, 1 AS tier FROM orders WHERE o_orderstatus NOT IN ('P', 'F')
UNION ALL SELECT o_orderkey, '1-URGENT', o_totalprice * 2, 0 FROM orders WHERE o_orderstatus = 'P')"""


@query("two_tier_search", f"SELECT _id, o_totalprice, CAST(tier AS INTEGER) AS tier FROM {_TIERS} WHERE o_orderpriority = '1-URGENT'")
def two_tier_search(spark, sf_dir):
    return searching.search(_tiers(spark, sf_dir), dsl={"term": {"o_orderpriority": "1-URGENT"}}, limit=None, fields=["o_totalprice", "tier"])


@query("two_tier_sorted", f"SELECT _id, o_totalprice FROM {_TIERS} ORDER BY o_totalprice DESC, _id LIMIT 40 OFFSET 5")
def two_tier_sorted(spark, sf_dir):
    return searching.search(_tiers(spark, sf_dir), "*", sort="o_totalprice", limit=40, offset=5, fields=["o_totalprice"])


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir where it is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif spark.sparkContext.master.startswith("local"):
            import tempfile

            named = "file://" + tempfile.mkdtemp(prefix="lakefind-")
            spark.sparkContext.setCheckpointDir(named)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{named.rstrip('/')}/lakefind-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder when the process ends; results may be read until then."""
    if spark.sparkContext._jsc is not None:
        try:
            Files(spark, path).delete()
        except Exception:  # the session may be gone; its shared folder goes with it
            pass


@query("incremental_changes", "SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def incremental_changes(spark, sf_dir):
    """A table of all finished orders; then the others are appended: what was added since."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("_id"), "o_orderstatus", "o_totalprice")
    t = VersionedTable(spark, scratch(spark))
    v = t.overwrite(orders.where("o_orderstatus = 'F'"))
    t.append(orders.where("o_orderstatus <> 'F'"))
    added, _, _ = t.changed_rows(v)
    return added.select("_id", "o_totalprice")


@query("removed_ids", "SELECT CAST(c_custkey AS VARCHAR) AS _id FROM customer WHERE c_acctbal < 0")
def removed_ids(spark, sf_dir):
    """Ids that a delete takes away: those of the rewritten files that are not there again."""
    t = VersionedTable(spark, scratch(spark))
    v = t.overwrite(load(spark, sf_dir, "customer").withColumn("_id", F.col("c_custkey").cast("string")))
    t.delete_where(F.col("c_acctbal") < 0)
    added, removed, _ = t.changed_rows(v)
    return mutate.delete(removed, added)


@query("time_travel", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 2")
def time_travel(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    t = VersionedTable(spark, scratch(spark))
    v = t.overwrite(n.where("n_regionkey < 2"))
    t.append(n.where("n_regionkey >= 2"))
    return t.read(v).select("n_nationkey", "n_name")


@query("compaction_rows", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def compaction_rows(spark, sf_dir):
    """Events in many small segments, merged as the planner says: the rows stay the same."""
    from .operators.compaction import MergePolicy, plan

    t = VersionedTable(spark, scratch(spark))
    t.overwrite(load(spark, sf_dir, "events"), max_rows=1000)
    s = t.snapshot()
    for group in plan(s.files, MergePolicy.of(4)):
        t.commit(t.write_files(t.files(group, t.schema()).coalesce(1)), group)
    return t.read().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# -- documents, schemas, formats ---------------------------------------------


@query("build_documents", "SELECT CAST(event_id AS VARCHAR) AS _id, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, epoch_us(ts) AS us FROM events")
def build_documents(spark, sf_dir):
    """Events as JSON documents with a nested object, built into typed columns."""
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), "event_type", "value", F.from_json("props", "k double").alias("props"), "ts")
    built = documents.build(documents.source_of(e), Schema({"event_type": "keyword", "value": "numeric", "props.k": "numeric", "ts": "date"}))
    return documents.strict(built).select("_id", "event_type", "value", F.col("`props.k`").alias("k"), F.unix_micros("ts").alias("us"))


@query("schema_infer", "SELECT * FROM (VALUES ('event_type', 'keyword'), ('props.k', 'numeric'), ('ts', 'date'), ('value', 'numeric')) AS t(field, kind)")
def schema_infer(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_type", "value", F.from_json("props", "k bigint").alias("props"), "ts")
    found = infer_json(documents.source_of(e))
    return spark.createDataFrame(sorted(found.fields.items()), "field string, kind string")


@query("schema_columnar", "SELECT * FROM (VALUES ('embedding', 'numeric', true), ('label', 'numeric', false), ('vec_id', 'numeric', false)) AS t(field, kind, multi)")
def schema_columnar(spark, sf_dir):
    s = infer_struct(load(spark, sf_dir, "embeddings").schema)
    return spark.createDataFrame([(f, k, f in s.multi) for f, k in s.fields.items()], "field string, kind string, multi boolean")


def _round_trip(name: str, write) -> None:
    def run(spark, sf_dir):
        path = f"{scratch(spark)}.{name}"
        write(load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
        return read_file(spark, path, name).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")

    query(f"format_{name}", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")(run)


_round_trip("csv", lambda df, p: df.write.csv(p, header=True))
_round_trip("ndjson", lambda df, p: df.write.json(p))
_round_trip("parquet", lambda df, p: df.write.parquet(p))
_round_trip("json", lambda df, p: df.agg(F.to_json(F.collect_list(F.struct("*"))).alias("v")).write.text(p))


@query("index_search", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 5000")
def index_search(spark, sf_dir):
    """A whole index: created, filled from a table, searched."""
    from .engine import Engine

    idx = Engine(spark, scratch(spark)).create("customers", {"fields": {"c_name": "keyword", "c_mktsegment": "keyword", "c_acctbal": "numeric"}})
    idx.index(load(spark, sf_dir, "customer").withColumn("_id", F.col("c_custkey")))
    return idx.search("+c_mktsegment:BUILDING +c_acctbal:>=5000", limit=None, fields=["c_name", "c_acctbal"])


@query("index_fresh_search", "SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_totalprice FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '2-HIGH'")
def index_fresh_search(spark, sf_dir):
    """An index that is behind its source: new versions are merged in when it is searched."""
    from .engine import Engine

    root = scratch(spark)
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("_id"), "o_orderstatus", "o_totalprice", "o_orderpriority")
    t = VersionedTable(spark, f"{root}/source")
    t.overwrite(orders.where("o_orderstatus <> 'P'"))
    idx = Engine(spark, f"{root}/data").create("orders", source=f"{root}/source")
    idx.sync()
    t.append(orders.where("o_orderstatus = 'P'"))
    t.delete_where(F.col("o_orderstatus") == "F")
    return idx.search('o_orderpriority:"2-HIGH"', limit=None, fields=["o_totalprice"])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best English documents of some length for a text query."""
    dsl = {"bool": {"must": {"match": {"text": "that and the"}}, "filter": [{"term": {"lang": "en"}}, {"range": {"n_chars": {"gte": 200}}}]}}
    return searching.search(corpus(spark, sf_dir, "documents"), dsl=dsl, limit=20, fields=["lang", "n_chars"], score=True)


from . import queries_index as _index  # noqa: E402, F401 - registers its queries here
