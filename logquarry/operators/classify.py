"""Routing of questions as jobs (Q1-Q3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.functions.redaction import scrub
from logquarry.functions.routing import routes


def classify(questions: DataFrame, question: str = "question") -> DataFrame:
    """Questions with the array of branches they go to.  Matching sees the raw text."""
    return questions.withColumn("routes", routes(F.coalesce(F.col(question), F.lit(""))))


def route_mix(classified: DataFrame, by: list[str]) -> DataFrame:
    """Questions per set of routes."""
    label = F.when(F.size("routes") == 0, "unsupported").otherwise(F.array_join("routes", "+"))
    return classified.groupBy(*by, label.alias("route_set")).agg(F.count(F.lit(1)).alias("n"))


def fan_out(classified: DataFrame) -> DataFrame:
    """One redacted row per question and branch."""
    return scrub(classified.withColumn("route", F.explode("routes")).drop("routes"))
