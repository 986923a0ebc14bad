"""The registered queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bounded_packing,
    chat_parts,
    counterfactual_toxicity,
    license_join,
    mih_topk,
    rlz_substrings,
    simhash_blocks,
    site_lines,
    suffix_decontamination,
    template_extraction,
)
from .tokens import TOKEN_RE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_decontamination(spark, sf_dir):
    """The matches that make documents contaminated; a document without a row here is clean."""
    return suffix_decontamination.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_site_lines(spark, sf_dir):
    """Every document without its source's boilerplate lines."""
    out = site_lines.drop_boilerplate(table(spark, sf_dir, "documents"), dropped="lines_dropped")
    return out.select("doc_id", "source", "text", F.col("n_chars").cast("bigint").alias("n_chars"), F.col("lines_dropped").cast("bigint").alias("lines_dropped"))


def op3_counterfactual_toxicity(spark, sf_dir):
    """The documents that the classifier rejects, with their scores."""
    docs = table(spark, sf_dir, "documents")
    model = counterfactual_toxicity.train(docs, table(spark, sf_dir, "labels"))
    return counterfactual_toxicity.score(docs, model).where(F.col("score") >= counterfactual_toxicity.THRESHOLD)


def op4_simhash_blocks(spark, sf_dir):
    """Each near-duplicate document with the one of its group that stays."""
    return simhash_blocks.duplicates(table(spark, sf_dir, "documents"))


def op5_template_extraction(spark, sf_dir):
    """The slots of every page."""
    return template_extraction.extract(table(spark, sf_dir, "pages"))


def op6_chat_parts(spark, sf_dir):
    """Every conversation, formatted."""
    return chat_parts.format_chats(table(spark, sf_dir, "conversations"))


def op7_mih_topk(spark, sf_dir):
    """The ten nearest codes, of all embeddings, to each embedding whose id is divisible by 20."""
    return mih_topk.nearest(table(spark, sf_dir, "embeddings"), asks=lambda i: i % 20 == 0)


def op8_rlz_substrings(spark, sf_dir):
    """Spans of at least 50 tokens that an earlier document has."""
    return rlz_substrings.duplicate_spans(table(spark, sf_dir, "documents"))


def op9_bounded_packing(spark, sf_dir):
    """The training windows that all documents are packed into."""
    return bounded_packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_license_join(spark, sf_dir):
    """Every line that meets a license template."""
    return license_join.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_suffix_decontamination, op2_site_lines, op3_counterfactual_toxicity, op4_simhash_blocks, op5_template_extraction,
        op6_chat_parts, op7_mih_topk, op8_rlz_substrings, op9_bounded_packing, op10_license_join,
    )
    return {f.__name__: f for f in ops}


_TOKENS = f"regexp_extract_all(lower(text), '{TOKEN_RE}')"

SQL_1 = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_TOKENS} AS w FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT doc_id, p, array_to_string(w[p:p+7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS u(p) WHERE len(w) >= 8),
bg AS (SELECT item_id, q, len(w) AS size, array_to_string(w[q:q+7], ' ') AS g FROM b, unnest(range(1, len(w) - 6)) AS u(q) WHERE len(w) >= 8),
hits AS (SELECT doc_id, item_id, size, p, q, p - q AS diagonal FROM dg JOIN bg USING (g)),
runs AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS run FROM hits),
found AS (SELECT doc_id, item_id, min(q) - 1 AS item_pos, min(p) - 1 AS doc_pos, count(*) + 7 AS n_tokens, any_value(size) AS size
          FROM runs GROUP BY doc_id, item_id, diagonal, run)
SELECT doc_id, item_id, CAST(item_pos AS INTEGER) AS item_pos, CAST(doc_pos AS INTEGER) AS doc_pos, CAST(n_tokens AS INTEGER) AS n_tokens
FROM found WHERE n_tokens >= least(13, size)
"""

SQL_2 = r"""
WITH l AS (SELECT doc_id, source, page, i, line, trim(line) AS k
           FROM (SELECT doc_id, source, md5(text) AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
                 FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)),
pages AS (SELECT source, count(DISTINCT text) AS total FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source),
bad AS (SELECT source, k FROM (SELECT source, k, count(DISTINCT page) AS n FROM l WHERE k <> '' GROUP BY source, k) JOIN pages USING (source)
        WHERE n >= 5 AND n > 0.002 * total),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (bad.k IS NULL) AS t, count(bad.k) AS dropped
         FROM l LEFT JOIN bad ON l.source = bad.source AND l.k = bad.k GROUP BY l.doc_id)
SELECT d.doc_id, d.source, CASE WHEN dropped > 0 THEN coalesce(t, '') ELSE d.text END AS text,
       CASE WHEN dropped > 0 THEN length(coalesce(t, '')) ELSE d.n_chars END AS n_chars, coalesce(dropped, 0) AS lines_dropped
FROM documents d LEFT JOIN kept USING (doc_id)
"""


SQL_7 = """
WITH usual AS (SELECT len(embedding) AS n FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
codes AS (SELECT vec_id, min(c) AS c FROM (
          SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS c
          FROM embeddings, usual WHERE vec_id IS NOT NULL AND len(embedding) = n) GROUP BY vec_id),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, hamming(a.c, b.c) AS distance FROM codes a JOIN codes b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs)
SELECT query_id, neighbour_id, CAST(distance AS INTEGER) AS distance, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10
"""

SQL_8 = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
g AS (SELECT doc_id, p - 1 AS p, md5(array_to_string(w[p:p+49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS u(p) WHERE len(w) >= 50),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first FROM g),
r AS (SELECT *, CASE WHEN p > lag(p) OVER o + 50 THEN 1 WHEN lag(p) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM f WHERE first < doc_id
      WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM r)
SELECT doc_id, CAST(min(p) AS INTEGER) AS start_token, CAST(max(p) + 50 AS INTEGER) AS end_token, min(first) AS first_doc_id FROM s GROUP BY doc_id, span
"""

_VALUES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in license_join.TEMPLATES.items())
SQL_10 = f"""
WITH t AS (SELECT template, list_distinct(w) AS w, len(list_distinct(w)) AS size, 2 * len(w) AS cap, greatest(1, ceil(0.8 * len(list_distinct(w)) - 1e-9)) AS need
           FROM (SELECT template, regexp_extract_all(lower(text), '{TOKEN_RE}') AS w FROM (VALUES {_VALUES}) AS v(template, text))),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT r, doc_id, i, regexp_extract_all(lower(line), '{TOKEN_RE}') AS w FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d)),
p AS (SELECT r, doc_id, i, w, count_if(len(w) = 0) OVER o AS part, sum(len(w)) OVER o AS ends FROM l WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, doc_id, i, part, ends, ends - len(p.w) AS begins, template, list_intersect(list_distinct(p.w), t.w) AS c, size, cap, need FROM p JOIN t ON list_has_any(p.w, t.w)),
rich AS (SELECT r, part, template FROM h GROUP BY r, part, template HAVING len(list_distinct(flatten(list(c)))) >= any_value(need)),
q AS (SELECT h.* FROM h JOIN rich USING (r, part, template)),
c AS (SELECT a.r, a.doc_id, a.template, a.size, a.i AS line, b.i AS last_line, len(list_distinct(flatten(list(m.c)))) AS common
      FROM q a JOIN q b ON a.r = b.r AND a.part = b.part AND a.template = b.template AND b.i >= a.i AND (b.i = a.i OR b.ends - a.begins <= a.cap)
      JOIN q m ON m.r = a.r AND m.part = a.part AND m.template = a.template AND m.i BETWEEN a.i AND b.i
      GROUP BY ALL HAVING common >= any_value(a.need)),
s AS (SELECT * FROM c WHERE line = last_line OR NOT EXISTS (SELECT 1 FROM c x WHERE x.r = c.r AND x.template = c.template AND x.line >= c.line AND x.last_line <= c.last_line AND (x.line > c.line OR x.last_line < c.last_line)))
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(last_line AS INTEGER) AS last_line, template, CAST(common AS INTEGER) AS common_tokens, common / size AS containment FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_decontamination": SQL_1, "op2_site_lines": SQL_2, "op7_mih_topk": SQL_7, "op8_rlz_substrings": SQL_8, "op10_license_join": SQL_10}
