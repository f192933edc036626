"""Tracebacks and failure lines in a text (E1-E3, E6) as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.functions import patterns as P
from logquarry.functions.expressions import once

NO_STRINGS = "array<string>"


def _contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _has_failure_word(text: Column) -> Column:
    return once(F.lower(text), lambda low: _contains_any(low, P.FAILURE_WORDS))


def tracebacks(text: Column) -> Column:
    """Every traceback up to the first blank line or the end, in order.

    The pattern runs only where the heading occurs.
    """
    found = F.regexp_extract_all(text, F.lit(P.TRACE_BLOCK), F.lit(1))
    return F.when(text.contains(P.TRACE_HEADING), found).otherwise(F.array().cast(NO_STRINGS))


def _failing_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), _has_failure_word)


def failure_lines(text: Column) -> Column:
    """Lines that contain a failure word in any case."""
    return F.when(_has_failure_word(text), _failing_lines(text)).otherwise(F.array().cast(NO_STRINGS))


def failure_kind(text: Column) -> Column:
    """``traceback``, ``lines`` or ``none``."""
    return (
        F.when(text.contains(P.TRACE_HEADING), "traceback").when(_has_failure_word(text), "lines").otherwise("none")
    )


def failure_text(text: Column) -> Column:
    """The extract as one text: tracebacks, else failure lines, else a fixed sentence."""
    return (
        F.when(text.isNull(), None)
        .when(
            text.contains(P.TRACE_HEADING),
            F.concat(F.lit(P.TRACES_TITLE), F.array_join(tracebacks(text), "\n")),
        )
        .when(
            _has_failure_word(text),
            F.concat(F.lit(P.LINES_TITLE), F.array_join(_failing_lines(text), "\n")),
        )
        .otherwise(P.NO_FAILURE)
    )


def frames(trace: Column) -> Column:
    """The call stack, outermost first, as an array of file, line and function."""
    pattern = P.FRAME.replace("(?m)", "(?md)")
    found = F.regexp_extract_all(trace, F.lit(pattern), F.lit(0))
    return F.transform(
        found,
        lambda frame: F.struct(
            F.regexp_extract(frame, pattern, 1).alias("file"),
            F.regexp_extract(frame, pattern, 2).try_cast("bigint").alias("line"),
            F.regexp_extract(frame, pattern, 3).alias("function"),
        ),
    )


def exception(trace: Column) -> Column:
    """Type and message of a traceback: the first unindented ``Type: text`` line after the last frame, and all lines
    that follow it.  Both are null when there is no such line."""
    pattern = P.EXCEPTION.replace("(?m)", "(?md)")

    def parts(closing: Column) -> Column:
        found = F.regexp_extract(closing, pattern, 1)
        said = F.concat(F.regexp_extract(closing, pattern, 2), F.regexp_extract(closing, pattern, 3))
        known = found != ""
        return F.struct(
            F.when(known, found).alias("type"), F.when(known, F.rtrim(said, F.lit("\n"))).alias("message")
        )

    return once(F.regexp_replace(trace, F.lit(P.UP_TO_LAST_FRAME), F.lit("")), parts)
