"""Checks of log records against the canonical schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.schema import LEVELS, LOG_COLUMNS


def validate_logs(logs: DataFrame) -> DataFrame:
    """`logs` with an array of broken rules, empty for a sound record.

    Rules: every field present, the level one of the known ones, the timestamp and
    the line number readable as such (they may arrive as text).
    """
    rules = []
    for name in LOG_COLUMNS:
        value = F.col(name)
        rules.append(F.when(value.isNull(), f"missing_{name}"))
        if name == "level":
            rules.append(F.when(~value.isin(*LEVELS), "unknown_level"))
        elif name == "timestamp":
            rules.append(F.when(value.isNotNull() & value.cast("string").try_cast("timestamp_ntz").isNull(),
                                "bad_timestamp"))
        elif name == "line_number":
            rules.append(F.when(value.isNotNull() & value.cast("string").try_cast("bigint").isNull(),
                                "bad_line_number"))
    return logs.withColumn("errors", F.array_compact(F.array(*rules)))


def clean(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") == 0).drop("errors")


def quarantine(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") > 0)


def violation_counts(validated: DataFrame) -> DataFrame:
    """Violations per rule and app."""
    return (
        quarantine(validated)
        .select("app", F.explode("errors").alias("rule"))
        .groupBy("rule", "app")
        .agg(F.count(F.lit(1)).alias("n"))
    )
