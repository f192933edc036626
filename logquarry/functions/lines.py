"""Line splitting and log header parsing as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.functions import patterns as P

# A line never holds a line feed, so one can separate the parsed header fields.
_MARK = "\n"
_FIELDS = ("timestamp", "level", "app", "source_file", "line_number", "message")


def split_lines(text: Column) -> Column:
    """The lines of `text` as an array.

    Most texts are one line, so substring searches look for a line end first: they cost far
    less than a pattern, and splitting compiles its pattern anew for each row.
    """
    ends = reduce(lambda a, b: a | b, [text.contains(e) for e in P.LINE_ENDS])
    return F.when(ends, F.split(text, P.LINE_BREAK)).otherwise(F.array(text))


def is_not_blank(line: Column) -> Column:
    """A printable ASCII character in front settles it for nearly every line."""
    return F.substring(line, 1, 1).between("!", "~") | line.rlike(P.java(P.NOT_BLANK))


def mark_header(line: Column) -> Column:
    """A header line as its six fields joined by line feeds; any other line as is.

    One pass of the pattern serves both to tell headers from other lines and
    to cut them up.  The message is what the pattern leaves over.
    """
    fields = "".join(f"${i}{_MARK}" for i in range(1, len(_FIELDS)))
    return F.regexp_replace(line, F.lit(P.java(P.LOG_HEADER)), F.lit(fields))


def is_header(marked: Column) -> Column:
    return marked.contains(_MARK)


def header_fields(marked: Column) -> dict[str, Column]:
    """The six fields of a marked header as strings."""
    parts = F.split(marked, _MARK, len(_FIELDS))
    return {name: parts.getItem(i) for i, name in enumerate(_FIELDS)}


def typed(value: Column, sql_type: str, on_bad: str, what: str) -> Column:
    """`value` cast to `sql_type`; a bad value fails the job, or is null with ``quarantine``.

    The cast to a timestamp without zone does not pass through the session zone,
    and the header pattern has already fixed the layout.
    """
    cast = value.try_cast(sql_type)
    if on_bad == "quarantine":
        return cast
    if on_bad != "fail":
        raise ValueError(f"on_bad must be 'fail' or 'quarantine', not {on_bad!r}")
    return F.when(
        cast.isNull() & value.isNotNull(),
        F.raise_error(F.concat(F.lit(f"bad {what} in log header: "), value)).cast(sql_type),
    ).otherwise(cast)
