"""Reading raw text logs."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions import lines as L
from logquarry.operators.stitch import split_to_lines, stitch

_BLOCK_BITS = 16  # rows of a split that one task puts in order: 2 ** _BLOCK_BITS


def escape_glob(path: str) -> str:
    """`path` with the characters that would start a file pattern taken literally."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def read_log_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of the files under `path`, or several paths, with their order key.

    The id grows in file order inside a split, and the split's start orders the
    splits, so no file is read whole.  A split is cut into blocks of ``2 ** _BLOCK_BITS``
    ids, so that neither its size nor a compressed file, which is one split, decides what a task holds.
    """
    try:
        raw = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no log at {path}") from error
        raise
    placed = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )
    return placed.select("file", F.struct("start", F.shiftright("seq", _BLOCK_BITS).alias("part")).alias("block"), "seq", "value")


def read_logs(
    spark: SparkSession, path: str | list[str], on_bad: str = "fail", row_ids: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The records of a file, a folder or a file pattern; see `stitch` for the options."""
    return stitch(read_log_lines(spark, path), on_bad=on_bad, row_ids=row_ids, keep=keep)


def count_records(spark: SparkSession, path: str, on_bad: str = "fail") -> int:
    """How many records `read_logs` would give.  Every header starts one, so no line is shuffled."""
    headers = split_to_lines(read_log_lines(spark, path)).where(L.is_header(F.col("line")))
    if on_bad == "quarantine":
        return headers.count()
    fields = L.header_fields(F.col("line"))
    time = L.typed(fields["timestamp"], "timestamp_ntz", on_bad, "timestamp")
    number = L.typed(fields["line_number"], "bigint", on_bad, "line number")
    # Looking at the typed values makes a bad one fail here as it would in `read_logs`.
    return headers.agg(F.count_if(time.isNotNull() & number.isNotNull())).first()[0]
