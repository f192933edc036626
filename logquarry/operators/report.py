"""Markdown reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import patterns as P
from logquarry.functions.redaction import scrub_text


def report_text(question: Column, diagnosis: Column, result: Column, warnings: Column) -> Column:
    """The unredacted report.  Sections without content are left out; `warnings` is
    a text of bullets or null."""
    title = F.btrim(F.coalesce(question, F.lit("")), F.lit(P.BLANKS))
    has_diagnosis = F.coalesce(diagnosis, F.lit("")) != ""
    has_result = F.coalesce(result, F.lit("")) != ""
    return F.concat_ws(
        "\n\n",
        F.when(title != "", F.concat(F.lit("# "), title)).otherwise(P.REPORT_TITLE),
        F.when(has_diagnosis, F.concat(F.lit(P.CAUSE_TITLE), diagnosis)),
        F.when(has_result, F.concat(F.lit(P.RESULT_TITLE), result)),
        F.when(~has_diagnosis & ~has_result, P.NO_RESULTS),
        F.when(warnings.isNotNull(), F.concat(F.lit(P.WARNINGS_TITLE), warnings)),
    )


def warning_bullets(warnings: DataFrame) -> DataFrame:
    """`warnings(question_id, pos, warning)` to one text of bullets per question.

    A report is one value and names every warning, so the warnings of a question meet in
    one row.  They are joined in runs of positions first, so that a question with very many
    of them is worked on by many tasks, and the last step only appends ready texts.
    """
    run = F.shiftright(F.col("pos").cast("long"), 10)
    bullet = F.concat(F.lit("- "), F.col("warning"))
    runs = warnings.groupBy("question_id", run.alias("run")).agg(_joined("pos", bullet))
    return runs.groupBy("question_id").agg(_joined("run", F.col("warnings")))


def _joined(order: str, text: Column) -> Column:
    items = F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("text"))))
    return F.array_join(F.transform(items, lambda w: w["text"]), "\n").alias("warnings")


def assemble_reports(
    questions: DataFrame, diagnoses: DataFrame, results: DataFrame, warnings: DataFrame
) -> DataFrame:
    """One redacted report per question.

    `questions(question_id, question)`; `diagnoses(question_id, analysis)` and
    `results(question_id, result)` hold at most one row per question, `warnings`
    any number.
    """
    joined = (
        questions.select("question_id", "question")
        .join(diagnoses.select("question_id", "analysis"), "question_id", "left")
        .join(results.select("question_id", "result"), "question_id", "left")
        .join(warning_bullets(warnings), "question_id", "left")
    )
    text = report_text(F.col("question"), F.col("analysis"), F.col("result"), F.col("warnings"))
    return joined.select("question_id", text.alias("report")).withColumn("report", scrub_text(F.col("report")))
