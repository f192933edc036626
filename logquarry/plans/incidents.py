"""Questions to reports (Q1 -> Q3 -> R1-R4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.functions import guards
from logquarry.functions import patterns as P
from logquarry.functions.redaction import scrub_text
from logquarry.functions.routing import DIAGNOSTIC, SQL
from logquarry.operators.classify import classify
from logquarry.operators.diagnostics import diagnose
from logquarry.operators.query import preview_per_group
from logquarry.operators.ranking import join_groups
from logquarry.operators.report import report_text, warning_bullets
from logquarry.plans import metrics


# Levels of an app that a report's table names; the table says how many more there are.
MOST_LEVELS = 50


def rejected_queries(statements: DataFrame) -> DataFrame:
    """Warnings for the statements the guard turns away: question_id, pos, warning."""
    reason = guards.query_rejection(F.col("query"))
    refused = statements.where(reason.isNotNull())
    return refused.select("question_id", "pos", F.concat(F.lit(P.QUERY_ERROR), reason).alias("warning"))


def incident_reports(questions: DataFrame, logs: DataFrame, statements: DataFrame) -> DataFrame:
    """One report per question about an app.

    `questions(question_id, app, question)`, `statements(question_id, pos, query)`.
    A question is answered only on the branches it is routed to; one without an app is about the records without
    one.  Counts and diagnoses are worked out once per app.  Small, they are broadcast; large, the join is by app and
    the adaptive planner splits a hot one.
    """
    counts = logs.groupBy("app", "level").agg(F.count(F.lit(1)).alias("records"))
    tables = preview_per_group(counts, ["app"], ["level", "records"], [F.desc("records"), F.asc("level")], MOST_LEVELS)
    per_app = join_groups(tables.select("app", "preview"), diagnose(logs).select("app", "analysis"), ["app"], "left")
    joined = join_groups(classify(questions), per_app, ["app"], "left").join(
        warning_bullets(rejected_queries(statements)), "question_id", "left"
    )
    text = report_text(
        F.col("question"),
        F.when(F.array_contains("routes", DIAGNOSTIC), F.col("analysis")),
        F.when(F.array_contains("routes", SQL), F.col("preview")),
        F.col("warnings"),
    )
    return joined.select("question_id", text.alias("report")).withColumn("report", scrub_text(F.col("report")))


def alert_reports(logs: DataFrame, threshold: float) -> DataFrame:
    """Extension: a diagnosis of each app and day whose error rate passes `threshold`.

    The rates are one row per app and day; joined back, they cut the log down to the days
    in question before any message is looked at.
    """
    rates = metrics.error_rate_by_app(logs).where(F.col("error_rate") > threshold)
    hot = join_groups(logs.withColumn("day", F.to_date("timestamp")), rates.select("app", "day"), ["app", "day"], "left_semi")
    return diagnose(hot, ["app", "day"]).select("subject", "analysis")
