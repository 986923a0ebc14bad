"""NDJSON, JSON, CSV and Parquet files, and their way into a versioned table."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IngestError
from .table import SEQ, VersionedTable

FORMATS = ("ndjson", "json", "csv", "parquet")
_SUFFIX = {".ndjson": "ndjson", ".jsonl": "ndjson", ".json": "json", ".csv": "csv", ".parquet": "parquet"}


def detect_format(path: str) -> str | None:
    """The format that a file's suffix says, in any case of letters."""
    low = path.lower()
    return next((f for s, f in _SUFFIX.items() if low.endswith(s)), None)


def parse_format(name: str) -> str:
    f = {"jsonl": "ndjson"}.get(name.lower(), name.lower())
    if f not in FORMATS:
        raise IngestError(f"unknown format '{name}', expected one of {', '.join(FORMATS)}, jsonl")
    return f


def expand(spark: SparkSession, pattern: str) -> list[str]:
    """The files of a path or a glob (``* ? [ ]``), sorted; there must be one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if re.search(r"[*?\[]", pattern):
        found = sorted(s.getPath().toString() for s in fs.globStatus(where) or [])
        if not found:
            raise IngestError(f"no files match '{pattern}'")
        return found
    if not fs.exists(where):
        raise IngestError(f"file not found: {pattern}")
    return [pattern]


@dataclass(frozen=True)
class Lines:
    """NDJSON, JSON or CSV text that comes line by line, such as standard input, in place of a file."""

    lines: Iterable[str]
    format: str


def leaves(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """The files of some paths in order, those of a folder by name; hidden ones are left out."""
    out: list[str] = []

    def walk(fs, where, top: bool) -> None:
        status = fs.getFileStatus(where)
        name = where.getName()
        if not top and name.startswith(("_", ".")):
            return
        if status.isDirectory():
            for s in sorted(fs.listStatus(where), key=lambda s: s.getPath().getName()):
                walk(fs, s.getPath(), False)
        else:
            out.append(fs.makeQualified(where).toUri().toString())

    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        walk(where.getFileSystem(spark._jsc.hadoopConfiguration()), where, True)
    return out


def _plain(uri: str) -> str:
    return re.sub(r"^(\w+):/+", r"\1:/", uri)


def _in_order(df: DataFrame, files: list[str]) -> DataFrame:
    """df with ``__lf_seq``: the place of a row's file in the list, of its split in the file, and its own."""
    spark = df.sparkSession
    order = spark.createDataFrame([(_plain(f), i) for i, f in enumerate(files)], "__lf_f string, __lf_n bigint")
    at = F.regexp_replace(F.col("_metadata.file_path"), r"^(\w+):/+", "$1:/")
    rows = df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], at.alias("__lf_p"), F.col("_metadata.file_block_start").alias("__lf_b"), F.monotonically_increasing_id().alias("__lf_i"))
    # Spark knows the list's size and broadcasts it only if it is small
    joined = rows.join(order, F.col("__lf_p") == F.col("__lf_f"))
    return joined.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], F.array("__lf_n", "__lf_b", "__lf_i").alias(SEQ))


def read_ndjson_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Documents for an index: ``_source`` and ``__lf_seq``; blank lines and lines that are no JSON object are left out."""
    files = leaves(spark, paths)
    lines = _in_order(spark.read.text(files), files).withColumnRenamed("value", "_source")
    v = F.try_parse_json("_source")
    return lines.where((F.trim("_source") != "") & F.schema_of_variant(v).startswith("OBJECT"))


def _why(e: Exception) -> str:
    return str(e.java_exception.getMessage() if isinstance(e, Py4JJavaError) else e).splitlines()[0]


def _checked(df: DataFrame, path: str) -> DataFrame:
    if not df.columns or df.isEmpty():
        raise IngestError(f"no rows in {path}")
    return df


def _first_line(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream)).readLine() or ""
    finally:
        stream.close()


def _readers(spark: SparkSession, kind: str, paths: list[str]) -> list[DataFrame]:
    """One read for all the files of a format; CSV files with different headers are read apart."""
    strict = spark.read.option("mode", "FAILFAST")
    match kind:
        case "ndjson":
            return [strict.json(paths)]
        case "json":
            return [strict.option("multiLine", True).json(paths)]
        case "csv":
            by: dict[str, list[str]] = {}
            for f in leaves(spark, paths):
                by.setdefault(_first_line(spark, f), []).append(f)
            return [strict.csv(fs, header=True, inferSchema=True) for fs in by.values()]
    return [spark.read.option("mergeSchema", True).parquet(*paths)]


def read_files(spark: SparkSession, paths: list[str], format: str | None = None, *, seq: bool = False) -> DataFrame | None:
    """The rows of files in any formats, None if there are none; columns that a file lacks are null.

    With seq, ``__lf_seq`` has the order of the rows: files as they are listed.
    """
    kinds: dict[str, list[str]] = {}
    for p in paths:
        kind = parse_format(format) if format else detect_format(p)
        if kind is None:
            raise IngestError(f"cannot tell the format of '{p}'")
        kinds.setdefault(kind, []).append(p)
    files = leaves(spark, paths) if seq else []
    try:
        frames = [df for kind, group in kinds.items() for df in _readers(spark, kind, group) if df.columns]
        frames = [_in_order(df, files) for df in frames] if seq else frames
        frames = [df for df in frames if not df.isEmpty()]
    except (PySparkException, Py4JJavaError) as e:
        raise IngestError(f"{', '.join(paths)}: {_why(e)}") from e
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def read_file(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """The rows of a file; malformed or empty input is an error."""
    df = read_files(spark, [path], format)
    if df is None:
        raise IngestError(f"no rows in {path}")
    return df


def read_lines(spark: SparkSession, lines: Iterable[str], format: str) -> DataFrame:
    """The rows of NDJSON, JSON or CSV text that comes line by line; Parquet needs a file."""
    kind = parse_format(format)
    if kind == "parquet":
        raise IngestError("parquet cannot be read from lines; give a file")
    text = [x.rstrip("\r\n") for x in lines]
    try:
        if kind == "json":
            rdd = spark.createDataFrame([("\n".join(text),)], "value string")
            whole = rdd.select(F.schema_of_json(F.lit("\n".join(text))).alias("s")).first()["s"]
            x = rdd.select(F.from_json("value", whole).alias("x"))
            df = x.select(F.explode("x").alias("x")).select("x.*") if whole.startswith("ARRAY") else x.select("x.*")
        else:
            rows = spark.createDataFrame([(x,) for x in text if x.strip()], "value string")
            if kind == "ndjson":
                df = spark.read.option("mode", "FAILFAST").json(rows.rdd.map(lambda r: r[0]))
            else:
                df = spark.read.option("mode", "FAILFAST").csv(rows.rdd.map(lambda r: r[0]), header=True, inferSchema=True)
        return _checked(df, "the lines")
    except (PySparkException, Py4JJavaError) as e:
        raise IngestError(f"lines: {_why(e)}") from e


def ingest(spark: SparkSession, source: str | Lines | list[str], target: str, *, format: str | None = None, mode: str = "overwrite") -> int | None:
    """Write all files of the sources, or lines, to a versioned table in one commit; the new version.

    Files may differ in their columns; what one lacks is null.  Rows with an
    ``_id`` keep the order of the files, so the last one with an id counts as
    the newest.  Without any rows nothing is written, and the result is None.
    """
    if mode not in ("overwrite", "append"):
        raise IngestError(f"unknown mode '{mode}', expected overwrite or append")
    origin = None
    if isinstance(source, Lines):
        df = read_lines(spark, source.lines, source.format)
    else:
        paths = [p for s in ([source] if isinstance(source, str) else source) for p in expand(spark, s)]
        df = read_files(spark, paths, format, seq=True)
        if df is None:
            return None
        if "_id" in df.columns:
            origin = "__lf_origin"
            df = df.withColumn(origin, F.concat_ws("-", F.lit(max(0, VersionedTable(spark, target).version() + 1)), *[F.element_at(SEQ, i).cast("string") for i in (1, 2)]))
        df = df.drop(SEQ)
    table = VersionedTable(spark, target)
    return table.append(df, origin=origin) if mode == "append" and table.exists() else table.overwrite(df, origin=origin)
