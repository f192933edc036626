"""The metric questions (M1-M11).  Each is one aggregation over the log table.

Partial counts are taken before the shuffle, so an app that holds most of the
records costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import patterns as P
from logquarry.functions.redaction import scrub
from logquarry.schema import ROW_ID


def _is_error() -> Column:
    return F.col("level") == "ERROR"


def error_rate_by_app(logs: DataFrame) -> DataFrame:
    counts = logs.groupBy("app", F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(_is_error()).alias("errors")
    )
    return counts.withColumn("error_rate", F.round(F.col("errors") / F.col("records"), 6))


def errors_by_app(logs: DataFrame) -> DataFrame:
    return logs.where(_is_error()).groupBy("app").agg(F.count(F.lit(1)).alias("errors"))


def errors_on_day(logs: DataFrame, day: str) -> DataFrame:
    """A range on the timestamp, so that the filter reaches the scan."""
    start = F.lit(day).cast("timestamp_ntz")
    in_day = (F.col("timestamp") >= start) & (F.col("timestamp") < start + F.expr("INTERVAL '1' DAY"))
    return logs.where(_is_error() & in_day).agg(F.count(F.lit(1)).alias("errors"))


def top_apps(logs: DataFrame, k: int = P.PREVIEW_ROWS) -> DataFrame:
    return errors_by_app(logs).orderBy(F.desc("errors"), F.asc("app")).limit(k)


def count_by_level(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def app_warnings(logs: DataFrame, app: str) -> DataFrame:
    return scrub(logs.where((F.col("app") == app) & (F.col("level") == "WARNING")))


def average_by_app(values: DataFrame, value: str) -> DataFrame:
    return values.groupBy("app").agg(F.round(F.avg(value), 4).alias("avg_value"), F.count(value).alias("n"))


def source_file_events(logs: DataFrame, source_file: str) -> DataFrame:
    found = logs.where(F.col("source_file") == source_file)
    return scrub(found).orderBy("timestamp", ROW_ID)


def first_event(logs: DataFrame) -> DataFrame:
    """The whole earliest record, by one aggregation instead of a sort."""
    record = F.min_by(F.struct(*logs.columns), F.struct("timestamp", ROW_ID)).alias("r")
    return scrub(logs.agg(record).select("r.*"))


def most_least(logs: DataFrame, by: str) -> DataFrame:
    """The values of `by` with the most and the fewest records, ties included."""
    counts = logs.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    ends = logs.sparkSession.sql(
        "SELECT *, 'most' AS place FROM {c} WHERE n = (SELECT max(n) FROM {c}) "
        "UNION ALL SELECT *, 'least' AS place FROM {c} WHERE n = (SELECT min(n) FROM {c})",
        c=counts,
    )
    return scrub(ends.withColumnRenamed(by, "value").select(F.lit(by).alias("dimension"), "value", "place", "n"))


def totals(values: DataFrame, value: str) -> DataFrame:
    return values.agg(
        F.round(F.sum(value), 2).alias("total"), F.count(value).alias("n"), F.round(F.avg(value), 4).alias("average")
    )
