"""Guarded read-only SQL with redacted results."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.functions import guards
from logquarry.functions import patterns as P
from logquarry.functions import statements as guard
from logquarry.functions.redaction import scrub, scrub_text
from logquarry.operators.ranking import join_groups, top_k_per_group


# What a Markdown table cannot hold as it is.
CELL_ESCAPES = (("\\", "\\\\"), ("|", "\\|"), ("\n", "<br>"))


def run_query(spark: SparkSession, query: str, params: Sequence | None = None, **tables: DataFrame) -> DataFrame:
    """The redacted result of one read-only statement.

    `params` fill ``?`` marks.  A table given by keyword can be named in braces in
    the statement.  Filters and groupings see the raw values.  The statement is judged by its words and by
    what the parser makes of it, before anything is analysed or run.
    """
    guards.check_query(query)
    guard.check_statement(spark, query, tables)
    return scrub(spark.sql(query, args=list(params) if params else None, **tables))


def _cell(column: Column) -> Column:
    """A value as a redacted table cell; marks that would end the cell or its row are escaped."""
    text = scrub_text(F.coalesce(column.cast("string"), F.lit("NULL")))
    for mark, shown in CELL_ESCAPES:
        text = F.replace(text, F.lit(mark), F.lit(shown))
    return text


def _escaped(value) -> str:
    text = "NULL" if value is None else str(value)
    for mark, shown in CELL_ESCAPES:
        text = text.replace(mark, shown)
    return text


def _heading(columns: Sequence[str]) -> str:
    return "| " + " | ".join(map(_escaped, columns)) + " |\n|" + " --- |" * len(columns)


def preview_per_group(
    df: DataFrame, group: Sequence[str], columns: Sequence[str], order: Sequence[Column], k: int = P.PREVIEW_ROWS
) -> DataFrame:
    """The first `k` rows of each group as a redacted Markdown table, and how many rows the group has.

    Null is a group like any other.  A group with more than `k` rows says so below its table.
    """
    top = top_k_per_group(df, group, order, k, "_rank")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(F.col(c)) for c in columns]), F.lit(" |"))
    tables = top.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_rank", row.alias("row")))).alias("rows"))
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("row_count"))
    more = F.col("row_count") - F.size("rows")
    text = F.concat(
        F.lit(_heading(columns) + "\n"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"),
        F.when(more > 0, F.concat(F.lit("\n\n"), more.cast("string"), F.lit(" more rows"))).otherwise(""),
    )
    return join_groups(tables, sizes, group).select(*group, text.alias("preview"), "row_count")


def query_text(
    spark: SparkSession, query: str, params: Sequence | None = None, k: int = P.PREVIEW_ROWS, **tables: DataFrame
) -> str:
    """The result of a statement as text for a report: at most `k` rows and the number of all, or what went wrong.

    Give the statement an ORDER BY if the choice of rows matters.
    """
    (row,) = query_results(spark, [(0, query)], k, params=params, **tables).collect()
    return row["text"]


def query_results(
    spark: SparkSession, statements: Sequence[tuple[int, str]], k: int = P.PREVIEW_ROWS, params: Sequence | None = None,
    **tables: DataFrame,
) -> DataFrame:
    """One row per statement (query_id, query): query_id, verdict, row_count, text.

    The text is a Markdown table of at most `k` rows with the number of the others, a sentence for an empty result,
    or what went wrong; a failing statement does not stop the others.  The verdict is the guard's, or ``failed``.
    Each result is counted and its first rows taken by a job of its own.
    """
    rows = [(i, *_outcome(spark, query, params, k, tables)) for i, query in statements]
    return spark.createDataFrame(rows, "query_id long, verdict string, row_count long, text string")


def _outcome(spark: SparkSession, query: str, params, k: int, tables: dict) -> tuple[str, int | None, str]:
    try:
        guards.check_query(query)
        guard.check_statement(spark, query, tables)
    except ValueError as error:
        rule = guards.first_broken_query_rule(query)
        return rule.verdict if rule else guards.ENGINE, None, f"{P.QUERY_ERROR}{error}"
    except Exception as error:  # the parser's
        return "failed", None, f"{P.QUERY_ERROR}{error}"
    try:
        result = run_query(spark, query, params, **tables)
        first = result.limit(k).collect()
        count = result.count() if len(first) == k else len(first)
    except Exception as error:  # the text is the result, whatever went wrong
        return "failed", None, f"{P.QUERY_ERROR}{error}"
    if not first:
        return guards.OK, 0, P.EMPTY_RESULT
    lines = [_heading(result.columns), *("| " + " | ".join(map(_escaped, row)) + " |" for row in first)]
    if count > len(first):
        lines += ["", f"{count - len(first)} more rows"]
    return guards.OK, count, "\n".join(lines)


def run_recorded(
    spark: SparkSession, query: str, out: str, journal: str, route: str = "sql", params: Sequence | None = None,
    **tables: DataFrame,
) -> DataFrame:
    """Extension: write a statement's redacted result to `out` and add a line to the `journal`.

    The line holds the statement, its route, start, duration, row count, how many values were redacted, and the
    error of a run that failed, which is raised after the line is written.  Counts are taken while the result is
    written.
    """
    started, counts, failure = time.time(), {}, None
    try:
        guards.check_query(query)
        guard.check_statement(spark, query, tables)
        raw = spark.sql(query, args=list(params) if params else None, **tables)
        changed = F.lit(0)
        for field in raw.schema:
            if isinstance(field.dataType, T.StringType):
                value = F.col(f"`{field.name}`")
                changed = changed + F.when(value != scrub_text(value), 1).otherwise(0)
        seen = Observation()
        wanted = [F.count(F.lit(1)).alias("row_count"), F.sum(changed.cast("long")).alias("redacted")]
        scrub(raw.observe(seen, *wanted)).write.parquet(out)
        counts = seen.get
    except Exception as error:
        failure = error
    line = (
        query, route, started, time.time() - started, counts.get("row_count"), counts.get("redacted") or 0,
        None if failure is None else str(failure),
    )
    schema = "query string, route string, started double, seconds double, row_count long, redacted long, error string"
    scrub(spark.createDataFrame([line], schema)).coalesce(1).write.mode("append").parquet(journal)
    if failure is not None:
        raise failure
    return spark.read.parquet(out)


def audit_queries(queries: DataFrame, query: str = "query") -> DataFrame:
    """A log of statements with the guard's verdict and the forbidden token."""
    return queries.withColumn("verdict", guards.query_verdict(F.col(query))).withColumn(
        "token", F.when(F.col("verdict").isin(guards.UNSAFE, guards.ENGINE), guards.unsafe_token(F.col(query)))
    )


def audit_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("verdict", "token").agg(F.count(F.lit(1)).alias("n"))
