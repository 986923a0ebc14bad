"""Line deduplication by how often a line occurs on its site.

For each host, the pages that contain a line are counted and divided by the
host's pages; a line above the boilerplate ratio is dropped from all the host's
pages.  Counting is one shuffle of (host, line hash) pairs with partial
aggregation, so a hot host spreads over all tasks.  What comes back per host is
short: a page has few distinct lines on average, and each boilerplate line
takes more than ``ratio`` of the pages, so a host has at most
(lines per page / ratio) of them.  These lists join the pages by broadcast if
they are small, else by a shuffled join with hot hosts salted.

Defined results
---------------
* Lines are what newlines separate; they are compared without leading and
  trailing blanks.  A blank line is never boilerplate.
* A line counts once for each different text (page) of the host it occurs in:
  copies of a page are one page, since a text that is copied often is no template.
* A line is boilerplate if it is on at least ``min_line_pages`` pages of the host
  and on more than ``ratio`` of them.  That is the rule on hosts of any size; a
  line on fewer pages is no sign of a template anywhere.
* A null host or null text leaves the row as it was and out of every count.
* A page keeps its row even if no line is left: its text is then empty.
* An empty table stays empty; other columns pass through, whatever their names.
  ``dropped`` must be a new name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_by_group, col, fresh, written

#: README has the recall and the clean lines lost at several ratios.
RATIO, LINE_PAGES = 0.002, 5


def _hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.xxhash64(F.trim(x)))


def boilerplate(docs: DataFrame, *, host: str, text: str, ratio: float, min_line_pages: int) -> tuple[DataFrame, DataFrame]:
    """The hashes of each host's boilerplate lines, columns h (host) and lines (array); and each host's pages, h and total."""
    pages = docs.select(col(docs, host).alias("h"), col(docs, text).alias("t")).where(F.col("h").isNotNull() & F.col("t").isNotNull())
    blank = F.xxhash64(F.lit(""))
    # a marker stands for the page itself, so that lines and pages are counted by one aggregation
    lines = pages.select("h", F.xxhash64("t").alias("page"), F.explode(F.concat(F.array(F.lit(None).cast("bigint")), F.array_distinct(_hashes(F.col("t"))))).alias("x")).where(F.col("x").isNull() | (F.col("x") != blank))
    counts = lines.groupBy("h", "x").agg(F.count_distinct("page").alias("n"))
    frequent = counts.where(F.col("x").isNull() | (F.col("n") >= min_line_pages))
    frequent, _ = written(frequent)
    totals = frequent.where(F.col("x").isNull()).select("h", F.col("n").alias("total"))
    found = frequent.where(F.col("x").isNotNull()).join(totals, "h").where(F.col("n") > F.lit(float(ratio)) * F.col("total")).groupBy("h").agg(F.collect_list("x").alias("lines"))
    return found, totals


def drop_boilerplate(
    docs: DataFrame,
    *,
    host: str = "source",
    text: str = "text",
    n_chars: str | None = "n_chars",
    dropped: str | None = None,
    ratio: float = RATIO,
    min_line_pages: int = LINE_PAGES,
) -> DataFrame:
    """The documents without their hosts' boilerplate lines.

    n_chars names the column with the text's length, if there is one; dropped
    names a new column with the number of dropped lines.
    """
    if dropped is not None and dropped.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column '{dropped}' already; name another for the dropped lines")
    found, totals = boilerplate(docs, host=host, text=text, ratio=ratio, min_line_pages=min_line_pages)
    table, path = written(found)
    key, lines, left = (fresh(x, docs) for x in ("lf_host", "lf_lines", "lf_left"))
    table = table.select(F.col("h").alias(key), F.col("lines").alias(lines))
    joined = attach_by_group(docs, host, table, path, key, totals.withColumnRenamed("h", key), "total")
    stay = F.filter(F.split(col(docs, text), "\n", -1), lambda x: ~F.array_contains(F.col(lines), F.xxhash64(F.trim(x))))
    joined = joined.withColumn(left, F.when(F.col(lines).isNotNull(), stay))
    new_text = F.when(F.col(left).isNull(), col(docs, text)).otherwise(F.array_join(F.col(left), "\n"))
    out = []
    for c in docs.columns:
        if c == text:
            out.append(new_text.alias(c))
        elif n_chars is not None and c == n_chars:
            out.append(F.when(F.col(left).isNull(), col(docs, c)).otherwise(F.length(F.array_join(F.col(left), "\n"))).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(col(docs, c))
    if dropped:
        out.append(F.when(F.col(left).isNull(), F.lit(0)).otherwise(F.size(F.split(col(docs, text), "\n", -1)) - F.size(left)).cast("int").alias(dropped))
    return joined.select(*out)
