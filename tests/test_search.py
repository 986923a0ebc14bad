"""Query languages, search, aggregations and the two-tier view on small corpora."""

import pytest
from pyspark.sql import functions as F

from lakefind.errors import QueryParseError, SchemaError
from lakefind.operators.aggregations import aggregate
from lakefind.operators.mutate import delete, last_wins, upsert
from lakefind.operators.search import get, matching, merged, parse_sort, query_tree, search
from lakefind.plans.compile import Corpus
from lakefind.schema import Schema

LABS = [
    ("d1", "glucose", "fasting blood sample", 45.0, "2024-06-15T10:00:00Z"),
    ("d2", "a1c", "borderline diabetic", 62.0, "2024-03-20T14:30:00Z"),
    ("d3", "glucose", "postprandial check", 33.0, "2024-09-01T08:00:00Z"),
    ("d4", "creatinine", "kidney function test", 55.0, "2024-01-10T09:00:00Z"),
]
SCHEMA = Schema({"name": "keyword", "notes": "text", "age": "numeric", "created_at": "date"})


def frame(spark, rows):
    df = spark.createDataFrame(rows, "_id string, name string, notes string, age double, t string")
    return df.withColumn("created_at", F.to_timestamp("t")).drop("t")


@pytest.fixture(scope="module")
def labs(spark):
    return Corpus(frame(spark, LABS).cache(), SCHEMA)


def ids(c, query=None, **kw):
    return [r["_id"] for r in search(c, query, **kw).collect()]


def found(c, dsl):
    return sorted(r["_id"] for r in search(c, dsl=dsl, limit=None).collect())


@pytest.mark.parametrize(
    "dsl, want",
    [
        ({"match_all": {}}, "d1 d2 d3 d4"),
        ({"match_none": {}}, ""),
        ({"term": {"name": "glucose"}}, "d1 d3"),
        ({"term": {"age": {"value": 62}}}, "d2"),
        ({"term": {"created_at": "2024-01-10T10:00:00+01:00"}}, "d4"),
        ({"term": {"notes": "diabet"}}, "d2"),
        ({"term": {"notes": "diabetic"}}, ""),
        ({"terms": {"name": ["glucose", "a1c"]}}, "d1 d2 d3"),
        ({"terms": {"name": []}}, ""),
        ({"match": {"notes": "diabetes"}}, "d2"),
        ({"match": {"notes": "fasting kidneys"}}, "d1 d4"),
        ({"match": {"notes": {"query": "blood fasting", "operator": "and"}}}, "d1"),
        ({"match": {"notes": "!!"}}, ""),
        ({"match": {"_id": "d3"}}, "d3"),
        ({"match_phrase": {"notes": "fasting blood"}}, "d1"),
        ({"match_phrase": {"notes": "blood fasting"}}, ""),
        ({"match_phrase": {"notes": "fasting sample"}}, ""),
        ({"match_phrase": {"notes": {"query": "fasting sample", "slop": 1}}}, "d1"),
        ({"multi_match": {"query": "glucose", "fields": ["name", "notes"]}}, "d1 d3"),
        ({"range": {"age": {"gte": 50}}}, "d2 d4"),
        ({"range": {"age": {"gt": 33, "gte": 45, "lt": 62}}}, "d1 d4"),
        ({"range": {"created_at": {"gte": "2024-06-01"}}}, "d1 d3"),
        ({"range": {"age": {}}}, "d1 d2 d3 d4"),
        ({"exists": {"field": "name"}}, "d1 d2 d3 d4"),
        ({"prefix": {"name": "glu"}}, "d1 d3"),
        ({"prefix": {"notes": "fasting blo"}}, "d1"),
        ({"wildcard": {"name": "g*c?se"}}, "d1 d3"),
        ({"wildcard": {"name": "lucose"}}, ""),
        ({"wildcard": {"notes": "kidn*"}}, "d4"),
        ({"bool": {"must": {"term": {"name": "glucose"}}, "must_not": {"match": {"notes": "postprandial"}}}}, "d1"),
        ({"bool": {"must": [{"term": {"name": "glucose"}}], "filter": [{"range": {"age": {"gte": 40}}}]}}, "d1"),
        ({"bool": {"must_not": {"term": {"name": "glucose"}}}}, "d2 d4"),
        ({"bool": {}}, "d1 d2 d3 d4"),
        ({"bool": {"should": [{"term": {"name": "a1c"}}, {"range": {"age": {"lt": 40}}}]}}, "d2 d3"),
        ({"bool": {"must": {"term": {"name": "glucose"}}, "should": {"term": {"name": "a1c"}}}}, "d1 d3"),
    ],
)
def test_dsl(labs, dsl, want):
    assert found(labs, dsl) == want.split()


@pytest.mark.parametrize(
    "dsl",
    [
        "{", {}, {"fuzzy": {"name": "x"}}, {"term": {}}, {"term": {"a": 1, "b": 2}}, {"term": {"nope": 1}}, {"term": {"_id": "d1"}}, {"term": {"age": "62"}}, {"range": {"name": {"gte": 1}}},
        {"multi_match": {"query": "x", "fields": []}}, {"multi_match": {"query": "x", "fields": ["age"]}}, {"match": {"age": "1"}}, {"prefix": {"age": "1"}}, {"exists": {"field": "nope"}},
        {"match": {"notes": {"query": "x", "operator": "xor"}}}, {"bool": {"must": {"match_none": {}}, "should": {"term": {"nope": 1}}}},
    ],
)
def test_dsl_errors(labs, dsl):
    with pytest.raises((QueryParseError, SchemaError)):
        search(labs, dsl=dsl)


@pytest.mark.parametrize(
    "query, want",
    [
        ('+name:"glucose"', "d1 d3"),
        ("notes:diabetes", "d2"),
        ("+__present__:__all__", "d1 d2 d3 d4"),
        ("__present__:notes", "d1 d2 d3 d4"),
        ("blood", "d1"),
        ("glucose", "d1 d3"),
        ("(glucose) AND (+notes:fasting)", "d1"),
        ("+name:glucose -notes:fasting", "d3"),
        ("name:a1c OR age:>=55", "d2 d4"),
        ("name:a1c name:creatinine", "d2 d4"),
        ("age:[45 TO 55]", "d1 d4"),
        ("age:{45 TO 62}", "d4"),
        ("age:[* TO 45}", "d3"),
        ("created_at:[2024-06-01 TO *]", "d1 d3"),
        ('notes:"fasting sample"~1', "d1"),
        ('notes:"kidney func"*', "d4"),
        ("NOT name:glucose", "d2 d4"),
        ("name:IN [a1c creatinine]", "d2 d4"),
        ("name:glucose AND NOT age:45", "d3"),
        ("*", "d1 d2 d3 d4"),
        ("age:*", "d1 d2 d3 d4"),
        ("age:45 OR name:glucose AND age:33", "d1 d3"),
        ("33", "d3"),
        ("_id:d2", "d2"),
    ],
)
def test_query_string(labs, query, want):
    assert sorted(ids(labs, query, limit=None)) == want.split()


@pytest.mark.parametrize("query", ["(a", "a)", "name:", "nope:x", "age:abc", "AND a", "a AND", "+", "name:[a TO b]"])
def test_query_string_errors(labs, query):
    with pytest.raises(QueryParseError):
        search(labs, query)


def test_sort_page_project(labs):
    every = {"dsl": {"match_all": {}}}
    assert ids(labs, sort="age:desc", **every) == ["d2", "d4", "d1", "d3"] == ids(labs, sort="age", **every)
    assert ids(labs, sort="age:asc", **every) == ["d3", "d1", "d4", "d2"]
    assert ids(labs, sort="created_at:desc", **every) == ["d3", "d1", "d2", "d4"]
    assert ids(labs, sort="age:desc", limit=2, offset=2, **every) == ["d1", "d3"]
    assert ids(labs, "+__present__:__all__", limit=2, offset=3) == ["d4"]
    assert ids(labs, limit=0, sort="name", **every) == []
    assert search(labs, "*", fields=["name", "nope"]).columns == ["_id", "name"]
    assert all(r["_score"] == 0 for r in search(labs, "*", sort="age", score=True).collect())
    for bad in ("name:asc", "notes", "nope:desc"):
        with pytest.raises(SchemaError):
            parse_sort(bad, labs)
    with pytest.raises(QueryParseError):
        query_tree(labs.schema)


def test_scores(labs):
    hits = search(labs, "notes:fasting OR notes:kidney OR name:glucose", score=True).collect()
    assert [h["_id"] for h in hits][0] == "d1" and all(h["_score"] > 0 for h in hits)
    filtered = search(labs, dsl={"bool": {"filter": {"term": {"name": "glucose"}}}}, score=True).collect()
    assert [h["_score"] for h in filtered] == [0.0, 0.0]
    boosted = search(labs, "name:a1c^9 notes:fasting", score=True).collect()
    assert boosted[0]["_id"] == "d2"
    assert get(labs, "d3").collect()[0]["name"] == "glucose" and get(labs, "zz").isEmpty()


def test_not_is_two_valued(spark):
    df = spark.createDataFrame([("1", None, None, None), ("2", "a", 1.0, ["x", "y"]), ("3", "b", 9.0, [])], "_id string, k string, v double, tags array<string>")
    c = Corpus(df, Schema({"k": "keyword", "v": "numeric", "tags": "keyword"}))
    no = lambda q: found(c, {"bool": {"must_not": q}})
    assert no({"term": {"k": "a"}}) == ["1", "3"] == no({"terms": {"k": ["a"]}}) == no({"term": {"tags": "x"}}) == no({"prefix": {"k": "a"}})
    assert no({"range": {"v": {"gt": 5}}}) == ["1", "2"] == no({"wildcard": {"k": "b*"}})
    assert no({"exists": {"field": "k"}}) == ["1"] and found(c, {"exists": {"field": "tags"}}) == ["2", "3"]
    assert no({"bool": {"must_not": {"term": {"k": "a"}}}}) == ["2"]
    assert no({"bool": {"must": [{"term": {"k": "a"}}, {"range": {"v": {"lt": 5}}}]}}) == ["1", "3"]
    assert ids(c, sort="v:asc", dsl={"match_all": {}}) == ["2", "3", "1"] and ids(c, sort="v:desc", dsl={"match_all": {}}) == ["3", "2", "1"]


def test_array_range_is_on_one_element(spark):
    c = Corpus(spark.createDataFrame([("1", [1.0, 10.0]), ("2", [5.0])], "_id string, v array<double>"), Schema({"v": "numeric"}))
    assert found(c, {"range": {"v": {"gt": 2, "lt": 8}}}) == ["2"]


def test_filters_reach_the_scan(spark):
    from tests.conftest import DATA

    df = spark.read.parquet(f"{DATA}/orders.parquet")
    c = Corpus(df, Schema({"o_orderstatus": "keyword", "o_totalprice": "numeric", "o_orderdate": "date"}), "o_orderkey")
    where = matching(c, query_tree(c.schema, "+o_orderstatus:F -o_totalprice:>1000 +o_orderdate:[1996-01-01 TO *]"))
    plan = df.filter(where).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1]
    assert "EqualTo(o_orderstatus,F)" in pushed and "GreaterThanOrEqual(o_orderdate" in pushed and "o_totalprice" in pushed.split("]")[0]


SHOP = [("1", "electronics", 100.0), ("2", "electronics", 200.0), ("3", "books", 15.0), ("4", "books", 25.0), ("5", "clothing", 50.0)]


def test_aggregations(spark):
    c = Corpus(spark.createDataFrame(SHOP, "_id string, category string, price double"), Schema({"category": "keyword", "price": "numeric"}))
    r = aggregate(c, {
        "by": {"terms": {"field": "category"}, "aggs": {"mean": {"avg": {"field": "price"}}, "h": {"histogram": {"field": "price", "interval": 100}}}},
        "mean": {"avg": {"field": "price"}}, "all": {"stats": {"field": "price"}}, "h": {"histogram": {"field": "price", "interval": 50}},
        "r": {"range": {"field": "price", "ranges": [{"to": 50}, {"from": 25, "to": 100}, {"from": 500}]}}, "p": {"percentiles": {"field": "price", "percents": [50]}},
        "u": {"cardinality": {"field": "category"}}, "n": {"value_count": {"field": "category"}}, "top": {"max": {"field": "price"}},
    }, exact=True)
    assert [(b["key"], b["doc_count"], b["mean"]["value"]) for b in r["by"]["buckets"]] == [("books", 2, 20.0), ("electronics", 2, 150.0), ("clothing", 1, 50.0)]
    assert [(b["key"], b["doc_count"]) for b in r["by"]["buckets"][1]["h"]["buckets"]] == [(100.0, 1), (200.0, 1)]
    assert r["mean"]["value"] == 78 and r["all"] == {"count": 5, "min": 15.0, "max": 200.0, "sum": 390.0, "avg": 78.0}
    assert [(b["key"], b["doc_count"]) for b in r["h"]["buckets"]] == [(0.0, 2), (50.0, 1), (100.0, 1), (150.0, 0), (200.0, 1)]
    assert [(b["key"], b["doc_count"]) for b in r["r"]["buckets"]] == [("*-50", 2), ("25-100", 2), ("500-*", 0)]
    assert r["p"]["values"] == {"50.0": 50.0} and r["u"]["value"] == 3 and r["n"]["value"] == 5 and r["top"]["value"] == 200
    where = matching(c, query_tree(c.schema, "category:electronics"))
    assert aggregate(c, {"m": {"avg": {"field": "price"}}}, where=where)["m"]["value"] == 150
    one = aggregate(c, {"by": {"terms": {"field": "category", "size": 1, "order": {"_key": "desc"}}, "aggs": {"in": {"terms": {"field": "category"}}}}})
    assert [b["key"] for b in one["by"]["buckets"]] == ["electronics"] and one["by"]["buckets"][0]["in"]["buckets"][0]["doc_count"] == 2


@pytest.mark.parametrize("request_", ["nope", {"a": {"nope": {"field": "price"}}}, {"a": {"avg": {}}}, {"a": {"avg": {"field": "price"}, "aggs": {"b": {"avg": {"field": "price"}}}}}, {"a": {"histogram": {"field": "price", "interval": 0}}}])
def test_aggregation_errors(spark, request_):
    c = Corpus(spark.createDataFrame(SHOP, "_id string, category string, price double"), Schema({"category": "keyword", "price": "numeric"}))
    with pytest.raises(QueryParseError):
        aggregate(c, request_)


def test_text_has_no_aggregations(labs):
    with pytest.raises(SchemaError):
        aggregate(labs, {"a": {"terms": {"field": "notes"}}})


def test_aggregations_of_nothing(spark):
    c = Corpus(spark.createDataFrame([], "_id string, category string, price double"), Schema({"category": "keyword", "price": "numeric"}))
    r = aggregate(c, {"by": {"terms": {"field": "category"}}, "s": {"sum": {"field": "price"}}, "m": {"avg": {"field": "price"}}, "h": {"histogram": {"field": "price", "interval": 5}}})
    assert r["by"]["buckets"] == [] == r["h"]["buckets"] and r["s"]["value"] == 0 and r["m"]["value"] is None


def test_two_tiers(spark, labs):
    gap = frame(spark, [("d1", "ldl", "UPDATED fasting", 46.0, None), ("d5", "glucose", "new", 20.0, None)])
    gone = spark.createDataFrame([("d2",)], "_id string")
    c = Corpus(merged(labs.df, gap, gone, tier="tier"), SCHEMA)
    assert found(c, {"term": {"name": "glucose"}}) == ["d3", "d5"]
    assert found(c, {"match_all": {}}) == ["d1", "d3", "d4", "d5"]
    assert ids(c, "*", sort="age:desc") == ["d4", "d1", "d3", "d5"]
    assert {r["_id"]: r["tier"] for r in c.df.collect()} == {"d1": 0, "d5": 0, "d3": 1, "d4": 1}


def test_upsert_and_delete(spark):
    base = spark.createDataFrame([("1", "a"), ("2", "b")], "_id string, v string")
    batch = spark.createDataFrame([("1", "x", 1), ("1", "y", 2), ("3", "z", 0)], "_id string, v string, seq int")
    assert sorted(map(tuple, upsert(base, batch, seq="seq").collect())) == [("1", "y"), ("2", "b"), ("3", "z")]
    assert last_wins(batch, seq="seq").count() == 2
    assert [r["_id"] for r in delete(base, spark.createDataFrame([("1",), ("9",)], "_id string")).collect()] == ["2"]


def _plain(node, doc):
    """The query model in Python, two-valued."""
    kind, body = next(iter(node.items()))
    if kind == "bool":
        must, should, no = (body.get(k, []) for k in ("must", "should", "must_not"))
        return all(_plain(x, doc) for x in must) and not any(_plain(x, doc) for x in no) and (bool(must) or not should or any(_plain(x, doc) for x in should))
    if kind == "exists":
        return doc[body["field"]] is not None
    f, v = next(iter(body.items()))
    if doc[f] is None:
        return False
    if kind == "term":
        return doc[f] == v
    return ("gte" not in v or doc[f] >= v["gte"]) and ("lt" not in v or doc[f] < v["lt"])


def test_random_trees(spark):
    import itertools
    import random

    docs = [{"_id": str(i), "k": k, "v": v} for i, (k, v) in enumerate(itertools.product([None, "a", "b"], [None, 1.0, 5.0, 9.0]))]
    df = spark.createDataFrame([(d["_id"], d["k"], d["v"]) for d in docs], "_id string, k string, v double")
    c = Corpus(df, Schema({"k": "keyword", "v": "numeric"}))
    rng = random.Random(7)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([{"term": {"k": "a"}}, {"term": {"k": "b"}}, {"range": {"v": {"gte": 5}}}, {"range": {"v": {"gte": 1, "lt": 9}}}, {"exists": {"field": "k"}}, {"term": {"v": 9.0}}])
        return {"bool": {k: [tree(depth - 1) for _ in range(rng.randint(0, 2))] for k in ("must", "should", "must_not")}}

    trees = [tree(3) for _ in range(40)]
    rows = df.select("_id", *[matching(c, query_tree(c.schema, dsl=t)).alias(f"t{i}") for i, t in enumerate(trees)]).collect()
    for i, t in enumerate(trees):
        assert [r["_id"] for r in rows if r[f"t{i}"]] == [d["_id"] for d in docs if _plain(t, d)], t


def test_texts_are_cut_once(spark):
    """One expression cuts the texts, whatever clauses and scores look at; texts that cannot match are not cut."""
    rows = [(i, f"word{i} common {'rare' if i % 9 == 0 else 'other'} thing") for i in range(60)]
    c = Corpus(spark.createDataFrame(rows, "id int, body string"), Schema({"body": "text"}), "id", "simple")
    for q in ("body:common body:rare body:thing", '+body:"common rare" +body:thing -body:word9', 'body:"common thing"~3 OR body:word1'):
        hits = search(c, q, score=True, limit=5)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert plan.count("regexp_extract_all") == 1 and hits.count() == 5
        assert plan.index("Contains(lower(body") > plan.index("regexp_extract_all")  # below it, that is, before
    stem = Corpus(c.df, c.schema, "id", "en_stem")
    assert ids(stem, "body:things", limit=100) == ids(c, "body:thing", limit=100) and len(ids(stem, "+body:words +body:rare", limit=100)) == 0


def test_every_word_begins_as_its_stem_says():
    from lakefind.functions.stemmer import beginning, stem

    ends = ("", "s", "es", "ed", "ing", "ly", "edly", "ingly", "ies", "ied", "ation", "ational", "ization", "izer", "ously", "ousness", "iveness", "ivity", "ability", "ably", "fulness", "alism", "ality", "ance", "ency", "ement", "ogy", "ical", "icate", "iest")
    words = [b + a + z for b in ("hop", "hope", "run", "ti", "ski", "sk", "d", "ly", "happ", "cr", "gener", "commun", "arsen", "b", "ab", "agre", "ug", "idl", "earl", "gentl", "relat", "oper", "é") for a in ends for z in ("", "s", "ed", "ing", "ly")]
    assert [w for w in words if not w.startswith(beginning(stem(w)))] == []


def test_top_hits_and_missing(spark):
    rows = [(1, "a", 3.0, "2024-01-01T00:00:00Z"), (2, "a", None, None), (3, "b", 9.0, "2024-02-01T00:00:00Z"), (4, None, 5.0, None), (5, "a", 7.0, "2024-01-09T00:00:00Z")]
    df = spark.createDataFrame(rows, "_id int, k string, v double, t string").withColumn("at", F.to_timestamp("t")).drop("t")
    c = Corpus(df, Schema({"k": "keyword", "v": "numeric", "at": "date"}))
    got = aggregate(c, {"by": {"terms": {"field": "k", "missing": "none"}, "aggs": {"best": {"top_hits": {"size": 2, "sort": [{"v": "desc"}], "_source": ["v"]}}, "s": {"sum": {"field": "v", "missing": 100}}}}})
    by = {b["key"]: b for b in got["by"]["buckets"]}
    assert [h["_id"] for h in by["a"]["best"]["hits"]["hits"]] == [5, 1] and by["a"]["best"]["hits"]["total"] == {"value": 3} and by["a"]["best"]["hits"]["hits"][0] == {"_id": 5, "v": 7.0}
    assert by["none"]["doc_count"] == 1 and by["a"]["s"]["value"] == 110.0
    top = aggregate(c, {"h": {"top_hits": {"size": 2, "from": 1, "sort": "v"}}, "n": {"date_histogram": {"field": "at", "fixed_interval": "31d", "missing": "2024-01-02"}}})
    assert [h["_id"] for h in top["h"]["hits"]["hits"]] == [4, 5] and sum(b["doc_count"] for b in top["n"]["buckets"]) == 5
    for bad in ({"h": {"top_hits": {"size": -1}}}, {"h": {"top_hits": {"sort": [3]}}}, {"h": {"top_hits": {"_source": "v"}}}):
        with pytest.raises(QueryParseError):
            aggregate(c, bad)


def test_too_many_buckets_stop_before_the_driver(spark):
    c = Corpus(spark.range(70_000).select(F.col("id").alias("_id"), F.col("id").cast("double").alias("v")), Schema({"v": "numeric"}))
    with pytest.raises(QueryParseError, match="more than"):
        aggregate(c, {"h": {"histogram": {"field": "v", "interval": 1}}})
