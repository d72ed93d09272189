"""Flow files, log lines and model tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a CSV reader of data frames takes for missing text (fixed values).
MISSING = ("", "NA", "N/A", "NaN", "nan", "None", "null", "NULL")
#: Rows that are looked at before all of them for what a column's type can't be.
HEAD_ROWS = 1000


def read_flows(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A flow CSV with header, columns by name. Without a schema the types are found from all rows.

    Infinities may be written as inf or Infinity, with a sign. Text that doesn't fit a numeric column
    of a given schema is null, and so are the words for missing values.
    """
    text = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return typed(missing_to_null(text), schema or flow_types(text))


def flow_types(text: DataFrame) -> T.StructType:
    """The types of columns of text: long, else double, else string; a column without values is double.

    A few rows already show of most columns what they aren't; only what these leave open is found by
    one aggregate over all rows, so that no cast fails on every row of a column of text.
    """
    rows = missing_to_null(text)

    def found(df: DataFrame, columns: Sequence[int], doubles: frozenset[int] = frozenset()) -> dict[str, int]:
        kinds = []
        for i in columns:
            x = F.col(f"`{df.columns[i]}`")
            whole = F.lit(False) if i in doubles else x.rlike(r"^\s*[+-]?\d{1,18}\s*$")
            kinds += [F.lit(1).alias(f"l{i}") if i in doubles else F.count_if(x.isNotNull() & ~whole).alias(f"l{i}"), F.count_if(x.isNotNull() & ~whole & x.try_cast("double").isNull()).alias(f"d{i}"), F.count(x).alias(f"n{i}")]
        return df.agg(*kinds).first().asDict() if kinds else {}

    first = found(rows.limit(HEAD_ROWS), range(len(rows.columns)))
    open_ = [i for i in range(len(rows.columns)) if not first[f"d{i}"]]
    seen = {**first, **found(rows, open_, frozenset(i for i in open_ if first[f"l{i}"]))}
    pick = lambda i: T.StringType() if seen[f"d{i}"] else T.DoubleType() if seen[f"l{i}"] or not seen[f"n{i}"] else T.LongType()
    return T.StructType([T.StructField(c, pick(i)) for i, c in enumerate(rows.columns)])


def typed(text: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema, cast from text."""
    if missing := [f.name for f in schema if f.name not in text.columns]:
        raise KeyError(f"no such columns: {missing}")
    cast = lambda f: F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else F.trim(F.col(f"`{f.name}`")).try_cast(f.dataType)
    return text.select(*[cast(f).alias(f.name) for f in schema])


def read_files(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """The rows of several flow files as read_flows gives them: every file's columns are found by its own header.

    Files may order their columns differently and hold others besides; a file that lacks a column of
    the schema is an error. Without a schema all files need the same names, and types are found from
    all their rows. Files of one header are read together, so a large one is read by many tasks; a file
    without a line has no rows.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        if header := tuple(spark.read.option("header", True).csv(path).columns):
            by_header.setdefault(header, []).append(path)
    texts = [spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).option("header", True).csv(own) for header, own in by_header.items()]
    if schema is not None:
        parts = [typed(missing_to_null(t), schema) for t in texts] or [spark.createDataFrame([], schema)]
        return reduce(DataFrame.unionByName, parts)
    if not texts:
        raise ValueError("without a schema a batch needs a file with a header")
    if len({frozenset(t.columns) for t in texts}) > 1:
        raise ValueError(f"files of one batch differ in their columns: {[t.columns for t in texts]}")
    text = reduce(DataFrame.unionByName, texts)
    return typed(missing_to_null(text), flow_types(text))


def stream_files(spark: SparkSession, path: str, files_per_batch: int = 1, finished: str | None = None) -> DataFrame:
    """A landing folder as a stream of the paths of its files, a file is a micro-batch; read_files() gives a batch's rows.

    Spark's streams of CSV files take columns by their place, whatever a header says. The stream of
    paths only lists files, and no content is read for it. finished: files that have been read are
    "deleted", or moved to a folder of that name, so that a landing folder of alternating captures
    doesn't fill up; None leaves them.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch)
    if finished == "deleted":
        reader = reader.option("cleanSource", "delete")
    elif finished:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", finished)
    return reader.load(path).select("path")


def stream_flows(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream of rows for transformations across files; all files need the schema's names in its order, another header is an error."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    reader = spark.readStream.schema(text).option("header", True).option("enforceSchema", False).option("maxFilesPerTrigger", files_per_batch)
    return typed(missing_to_null(reader.csv(path)), schema)


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream: a folder of part files or one file (which is found by its name in its folder)."""
    schema, at = spark.read.parquet(path).schema, spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def missing_to_null(df: DataFrame) -> DataFrame:
    names = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(*[F.when(F.col(f"`{c}`").isin(*MISSING), None).otherwise(F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


#: The layout of a log line (fixed values).
LOG_LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)(?:,\d{3})? - ([A-Z]+) - (.*)$"


def read_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(value, ts, level, message) of the lines of log files: of a folder or file, or of a folder's files as they come."""
    return parse_log((spark.readStream if stream else spark.read).text(path))


def log_line(ts: Column, level: Column, message: Column) -> Column:
    """`time - LEVEL - message`."""
    return F.concat_ws(" - ", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), level, message)


def parse_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """lines with ts, level and message of the log line in col; null where it isn't one."""
    part = lambda i: F.when(F.col(col).rlike(LOG_LINE), F.regexp_extract(F.col(col), LOG_LINE, i))
    return lines.withColumns({"ts": F.to_timestamp(part(1), "yyyy-MM-dd HH:mm:ss"), "level": part(2), "message": part(3)})


def metrics_message(metrics: DataFrame) -> Column:
    """The log message of a snapshot (total_requests, active, avg_duration, requests_per_minute, errors); its wording is fixed.

    The mean is taken to the microsecond, then rounded by its exact binary value: Java's %.4f rounds
    the shortest decimal, which differs where the fifth digit is a 5.
    """
    mean = F.udf(lambda v: None if v is None else f"{v:.4f}", "string")(F.round(metrics["avg_duration"], 6))
    return F.format_string("Server metrics - Requests: %d | Active: %d | Avg Response: %ss | Rate: %d/min | Errors: %d", metrics["total_requests"], metrics["active"], mean, metrics["requests_per_minute"], metrics["errors"])


NODE_SCHEMA = "tree_id int, node_id int, left int, right int, feature int, threshold double, impurity double, n_node_samples long, weighted_n double, value array<double>, decrease double"


def save_nodes(nodes: DataFrame, path: str) -> None:
    nodes.select(*[c.split()[0] for c in NODE_SCHEMA.split(", ")]).write.mode("overwrite").parquet(path)


def load_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The table of save_nodes; another schema, or a table without nodes, is an error."""
    nodes = spark.read.parquet(path)
    wanted = {tuple(c.split()[:2]) for c in NODE_SCHEMA.split(", ")}
    if missing := sorted(wanted - {(n, t.replace("bigint", "long")) for n, t in nodes.dtypes}):
        raise ValueError(f"not a node table, without {missing}")
    if nodes.isEmpty():
        raise ValueError("a model without nodes")
    return nodes
