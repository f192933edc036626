"""Question routing (Q1) as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.functions import patterns as P

DIAGNOSTIC, SQL = "diagnostic", "sql"


def routes(question: Column) -> Column:
    """The branches a question asks for, diagnostic before sql; empty when neither."""
    diagnostic = question.rlike(P.java(P.whole_words(P.DIAGNOSTIC_PHRASES), True))
    sql = question.rlike(P.java(P.whole_words(P.SQL_PHRASES), True))
    return F.array_compact(F.array(F.when(diagnostic, DIAGNOSTIC), F.when(sql, SQL)))
