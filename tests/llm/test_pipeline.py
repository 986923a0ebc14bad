"""The corpus pipeline: each stage on what the one before kept, against brute force."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakefind.llm import counterfactual_toxicity as toxicity
from tests.llm.test_ops import DATA, brute_groups, brute_lines, check_windows, docs_of, prose, words


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input rows, output rows) of every stage."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    # cases of every kind beside the table's own rows
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first()["text"]
    rng = np.random.default_rng(0)
    clean = [" ".join(f"clean{x}" for x in rng.integers(0, 10**6, 150)) for _ in range(3)]
    extra = [(9001, clean[0]), (9002, clean[0].upper() + "!"), (9003, clean[1] + "\n" + item + "\n" + clean[1]), (9004, clean[2]), (9005, None), (9006, "")]
    more = spark.createDataFrame([(i, t, "en", "extra") for i, t in extra], "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    docs = docs.unionByName(more)
    out = []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        path = f"file://{root}/{name}"
        stage(spark, docs, DATA).write.parquet(path)
        docs, columns = spark.read.parquet(path), docs.columns
        out.append((name, columns, before, docs.columns, [r for r in docs.collect()]))
    return out


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, columns, _, after, _ in stages[:-1]:
        assert after == columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_toxicity(spark, stages):
    _, _, before, _, after = stages[0]
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    by = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    z = model.logits(pa.array([t for _, t, *_ in before], pa.large_string()))
    stay = {d for (d, t, *_), x in zip(before, z) if not t or 1 / (1 + np.exp(-x)) < toxicity.THRESHOLD}
    kept = {r["doc_id"] for r in after}
    assert kept == stay and {9001, 9002, 9003, 9004, 9005, 9006} <= kept
    toxic, clean = ({d for d, v in by.items() if v == k} for k in (1, 0))
    assert len(toxic - kept) >= 0.9 * len(toxic) and len(clean & kept) >= 0.97 * len(clean)


def test_line_dedup(stages):
    _, _, before, _, after = stages[1]
    key = lambda x: (x[0], x[1] or "")
    assert sorted([(r["doc_id"], r["text"]) for r in after], key=key) == sorted(brute_lines([(d, t, s) for d, t, _, s, _ in before]), key=key)


def test_near_dedup(stages):
    _, _, before, _, after = stages[2]
    gone = {d for d, _ in brute_groups([(d, t) for d, t, *_ in before], 8)}
    assert 9002 in gone and {r["doc_id"] for r in after} == {d for d, *_ in before} - gone


def test_decontamination(spark, stages):
    _, _, before, _, after = stages[3]
    grams = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(r["text"])
        n = min(13, len(w))
        if len(w) >= 8:
            grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    sizes = {len(g) for g in grams}
    bad = {d for d, t, *_ in before for w in [words(t)] if any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))}
    assert 9003 in bad and {r["doc_id"] for r in after} == {d for d, *_ in before} - bad


def test_packing(stages):
    _, _, before, _, after = stages[4]
    check_windows(after, before, 2048)


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["window_id", "n_tokens", "pieces"] and out.count() > 0


def test_line_dedup_drops_rare_boilerplate(spark):
    """Lines on 1 % to 4 % of a source's pages go; lines of fewer than five pages stay."""
    rows = []
    for d in range(600):
        lines = [f"own line {d}", f"shared by three {d // 3}"]
        lines += [f"footer {k}" for k, every in enumerate((25, 50, 100)) if d % every == 0]
        rows.append((d, "\n".join(lines), "host"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    got = {r["doc_id"]: r for r in corpus_pipeline.line_dedup(spark, df, DATA).collect()}
    assert {d: r["text"] for d, r in got.items()} == {d: f"own line {d}\nshared by three {d // 3}" for d in range(600)}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_stages_take_odd_rows_and_other_columns(spark, tmp_path):
    """Null, empty and very long texts, null and repeated ids, repeated rows, columns of any name."""
    rng = np.random.default_rng(6)
    long = prose(rng, 50_000)
    rows = [(None, "null id", "s"), (None, "null id", "s"), (1, None, "s"), (2, "", "s"), (3, " \n\n", None), (4, "same text here", "s"), (4, "same text here", "s"), (4, "another text", "s"), (5, "same text here", "t"), (6, long, "s"), (7, None, None), (None, None, None)]
    docs = docs_of(spark, rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name == "packing":
            continue
        assert docs.columns == columns
        kept = sorted((str(r["doc_id"]), str(r["text"])[:40]) for r in docs.collect())
        everything = sorted((str(d), str(t)[:40]) for d, t, _ in rows)
        if name in ("toxicity", "line_dedup"):
            assert kept == everything
        else:
            # of the copies under ids 4 and 5 one stays, and of the rows under id 4 the first by text
            assert Counter(d for d, _ in kept) == Counter(["None"] * 3 + list("123467"))
    check_windows(docs.collect(), [(d, t, s) for d, t, s in [*rows[:5], (4, "another text", "s"), *rows[9:]]], 2048)


def test_stages_take_empty_tables(spark):
    docs = docs_of(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name
