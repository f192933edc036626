"""Reading record files by suffix: CSV, JSON, JSONL and Parquet."""

from __future__ import annotations

import os
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.functions import patterns as P
from logquarry.sources.text_logs import escape_glob

CORRUPT = "_corrupt_record"
SUFFIXES = (".csv", ".json", ".jsonl", ".parquet")


def read_table_file(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False, on_bad: str = "fail"
) -> DataFrame:
    """The records of one file or folder whose name ends in a known suffix.

    Broken input fails the job.  With ``on_bad="quarantine"`` and a schema, a broken record comes with its text in the
    column ``_corrupt_record`` instead, which is null for the others; `bad_records` counts them.

    Pass a schema for large files: without one, CSV and JSON are read twice.  Whole numbers come as bigint, and times
    as timestamps without zone.  A CSV file with line breaks inside quotes needs `multi_line`.  A ``.json`` file that
    is one value over many lines is told from one with a record per line, file by file; a folder may hold both.
    Files read whole cannot be split, so one task reads each; use JSONL or Parquet for large inputs.  Columns of whole
    files cannot be found out if the path holds characters of a file pattern; pass a schema then.
    """
    suffix = os.path.splitext(str(path).rstrip("/"))[1].lower()
    literal = escape_glob(str(path))
    if on_bad not in ("fail", "quarantine") or (on_bad == "quarantine" and schema is None):
        raise ValueError("on_bad is fail, or quarantine with a schema")
    try:
        if suffix not in SUFFIXES:
            spark.read.text(literal)
            raise ValueError(f"no reader for '{suffix}'; known suffixes are {', '.join(SUFFIXES)}")
        if suffix == ".parquet":
            return (spark.read.schema(schema) if schema else spark.read).parquet(literal)
        if suffix == ".csv":
            found = _reader(spark, schema, on_bad).option("escape", '"').csv(
                literal, header=True, inferSchema=schema is None, multiLine=multi_line
            )
        else:
            found = _read_json(spark, literal, str(path), suffix, schema, on_bad)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"nothing at {path}") from error
        raise
    return found if schema else _normal_types(found)


def bad_records(found: DataFrame) -> DataFrame:
    """Of records read with ``on_bad="quarantine"``: how many there are, and how many are broken."""
    broken = F.col(CORRUPT).isNotNull()
    return found.agg(F.count(F.lit(1)).alias("records"), F.count_if(broken).alias("broken"))


def _reader(spark: SparkSession, schema: T.StructType | None, on_bad: str) -> DataFrameReader:
    if on_bad == "fail":
        reader = spark.read.option("mode", "FAILFAST")
        return reader.schema(schema) if schema else reader
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(wide)


def _read_json(spark, literal: str, path: str, suffix: str, schema: T.StructType | None, on_bad: str) -> DataFrame:
    whole = _whole_files(spark, literal) if suffix == ".json" else []
    if whole and schema is None and literal != path:
        raise ValueError(f"pass a schema to read {path}: its name holds pattern characters")
    # Times are found by their look, as in CSV.
    reader = _reader(spark, schema, on_bad).option("inferTimestamp", True)
    if not whole:
        return reader.json(literal)
    single = F.json_array_length(F.concat(F.lit("["), F.col("value"), F.lit("]"))) == 1
    broken = spark.read.text(whole, wholetext=True).where(~F.coalesce(single, F.lit(False)))
    if on_bad == "fail" and broken.head(1):
        raise ValueError(f"a file of {path} is neither one JSON value nor a record per line")
    names = [r[0] for r in spark.read.text(literal).select("_metadata.file_path").distinct().collect()]
    lines = [escape_glob(_local(n)) for n in names if escape_glob(_local(n)) not in set(whole)]
    found = reader.json(whole, multiLine=True)
    return found.unionByName(reader.json(lines, multiLine=False), allowMissingColumns=True) if lines else found


def _whole_files(spark: SparkSession, path: str) -> list[str]:
    """The files whose first line that is not blank is not a whole record: arrays, and values that go on.

    One row per file reaches the driver, which lists the files for the reader anyway.
    """
    rows = spark.read.text(path).where(F.col("value").rlike(P.java(P.NOT_BLANK))).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    first = rows.groupBy("file").agg(F.min(F.struct("block", "at", "line")).alias("first"))
    opens = F.col("first.line").startswith("[") | ~F.col("first.line").endswith("}")
    return [escape_glob(_local(r["file"])) for r in first.where(opens).select("file").collect()]


def _local(uri: str) -> str:
    """A file's path as readers take it; Spark gives it with its characters encoded."""
    return unquote(uri)


def _normal_types(df: DataFrame) -> DataFrame:
    out = []
    for field in df.schema:
        value = df[f"`{field.name}`"]
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            value = value.cast("bigint").alias(field.name)
        elif isinstance(field.dataType, T.TimestampType):
            value = value.cast("timestamp_ntz").alias(field.name)
        out.append(value)
    return df.select(*out)
