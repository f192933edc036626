"""Context sampling of one text (E4, E5) as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry.functions import patterns as P
from logquarry.functions.expressions import once


def has_context_word(line: Column) -> Column:
    """Case matters here, unlike for failure lines."""
    found = line.contains(P.CONTEXT_WORDS[0])
    for word in P.CONTEXT_WORDS[1:]:
        found = found | line.contains(word)
    return found


def dropped_title(dropped: Column) -> Column:
    return F.concat(F.lit("\n\n... [TRUNCATED "), dropped.cast("string"), F.lit(" LINES] ...\n\n"))


def sample_text(text: Column, max_lines: int = P.MAX_LINES) -> Column:
    """A text of at most `max_lines` lines as it is; a longer one cut to its
    head, its telling middle lines and its tail."""

    def cut(lines: Column) -> Column:
        n = F.size(lines)
        head_size = F.least(F.lit(P.HEAD_LINES), n)
        tail_size = F.least(F.lit(P.TAIL_LINES), n - head_size)
        middle = F.slice(lines, head_size + 1, n - head_size - tail_size)

        def assemble(kept: Column) -> Column:
            return F.concat(
                F.array_join(F.slice(lines, 1, head_size), "\n"),
                dropped_title(n - head_size - tail_size - F.size(kept)),
                F.array_join(kept, "\n"),
                F.lit(P.CRASH_TITLE),
                F.array_join(F.slice(lines, n - tail_size + 1, tail_size), "\n"),
            )

        def choose(telling: Column) -> Column:
            return F.slice(F.when(F.size(telling) > 0, telling).otherwise(middle), 1, P.MIDDLE_LINES)

        kept = once(F.filter(middle, has_context_word), choose)
        return F.when(n > max_lines, once(kept, assemble))

    lines = F.split(F.btrim(text, F.lit(P.BLANKS)), "\n", -1)
    # The cut is null for a text that is short enough.
    return F.coalesce(once(lines, cut), text)
