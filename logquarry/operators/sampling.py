"""Context sampling per group over a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions import patterns as P
from logquarry.functions.redaction import scrub_text
from logquarry.functions.sampling import dropped_title, has_context_word
from logquarry.operators.ranking import join_groups, top_k_per_group
from logquarry.schema import ROW_ID
from logquarry.session import settle

HEAD, MIDDLE, TAIL, ALL = "head", "middle", "tail", "all"
_START, _END, _HIT = 0, 1, 2  # ways in which a row may come into a sample


def render_line(prefix: str = ""):
    """A record as it would stand in a log file; nothing stands for a null."""

    def shown(name: str, text=None):
        value = F.col(prefix + name)
        return F.coalesce(text(value) if text else value.cast("string"), F.lit(""))

    return F.concat(
        shown("timestamp", lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")), F.lit(" ["), shown("level"), F.lit("] "), shown("app"),
        F.lit(" ("), shown("source_file"), F.lit(":"), shown("line_number"), F.lit("): "), shown("message"),
    )


def log_lines(logs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Records as single lines in log order: the group, (timestamp, row id, pos), line."""
    return logs.select(
        *group, "timestamp", ROW_ID, F.posexplode(F.split(render_line(), "\n", -1)).alias("pos", "line")
    )


def sample_keys(
    lines: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    text: str = "line",
    max_lines: int = P.MAX_LINES,
) -> DataFrame:
    """Which rows `sample_context` takes: the group, the order, section, pos_in_section, group_lines.

    Every candidate is among the first or last rows of its group, or among its first
    flagged rows: at most HEAD flagged rows can sit in the head, which makes
    HEAD + MIDDLE flagged rows enough.  So one bounded selection and a count replace a sort of the
    group, and no text leaves the task that reads it.
    """
    enough = P.HEAD_LINES + P.MIDDLE_LINES
    most = {_START: max(enough, max_lines), _END: P.TAIL_LINES, _HIT: enough}
    keys = lines.select(*group, *order, F.coalesce(has_context_word(F.col(text)), F.lit(False)).alias("flagged"))
    ways = F.array(F.lit(_START), F.lit(_END), F.when(F.col("flagged"), F.lit(_HIT)))
    ways = keys.select("*", F.explode(F.array_compact(ways)).alias("way"))
    # Of the two orders only one is not null in a way.  They are columns, as a sort works its expressions out at every comparison.
    forth = {f"_forth_{i}": F.when(F.col("way") != _END, F.col(c)) for i, c in enumerate(order)}
    back = {f"_back_{i}": F.when(F.col("way") == _END, F.col(c)) for i, c in enumerate(order)}
    by = [*[F.asc(c) for c in forth], *[F.desc(c) for c in back]]
    picks = top_k_per_group(ways.withColumns({**forth, **back}), [*group, "way"], by, max(most.values()))
    picks = picks.where(reduce(lambda a, b: a | b, [(F.col("way") == w) & (F.col("rank") <= k) for w, k in most.items()]))
    picks = picks.groupBy(*group, *order).agg(
        F.bool_or("flagged").alias("flagged"),
        F.min(F.when(F.col("way") == _START, F.col("rank"))).alias("from_start"),
        F.min(F.when(F.col("way") == _END, F.col("rank"))).alias("from_end"),
    )
    sizes = lines.groupBy(*group).agg(F.count(F.lit(1)).alias("group_lines"))
    head_size = F.least(F.lit(P.HEAD_LINES).cast("long"), F.col("group_lines"))
    tail_size = F.least(F.lit(P.TAIL_LINES).cast("long"), F.col("group_lines") - head_size)
    placed = join_groups(picks, sizes, group).withColumn(
        "section",
        F.when(F.col("group_lines") <= max_lines, ALL)
        .when(F.col("from_start") <= head_size, HEAD)
        .when(F.col("from_end") <= tail_size, TAIL)
        .otherwise(MIDDLE),
    )
    # From here on a group holds a bounded number of rows.
    by_section = Window.partitionBy(*group, "section")
    chosen = (
        placed.withColumn("any_flagged", F.max("flagged").over(by_section))
        .where((F.col("section") != MIDDLE) | ~F.col("any_flagged") | F.col("flagged"))
        .withColumn("pos_in_section", F.row_number().over(by_section.orderBy(*[F.col(c).asc() for c in order])).cast("long"))
        .where((F.col("section") != MIDDLE) | (F.col("pos_in_section") <= P.MIDDLE_LINES))
    )
    return chosen.select(*group, *order, "section", "pos_in_section", "group_lines")


def sample_context(
    lines: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    text: str = "line",
    max_lines: int = P.MAX_LINES,
) -> DataFrame:
    """A bounded, telling set of rows of each group.

    A group of at most `max_lines` rows is kept whole (section ``all``).  Of a
    longer one: the head, the tail, and from between them the first rows with a
    context word, or the first rows if none has one.  `order` must be total.  Rows without a
    group form one of their own.  `max_lines` is bounded as in `top_k_per_group`.

    The rows are chosen by their keys and flags, see `sample_keys`; the choice is staged, and its texts are then looked up.
    """
    chosen = settle(sample_keys(lines, group, order, text, max_lines), "sample")
    texts = lines.select(*group, *order, F.col(text).alias("line"))
    return join_groups(texts, chosen, [*group, *order]).select(
        *group, "section", "pos_in_section", "group_lines", *order, "line"
    )


def within_budget(sample: DataFrame, group: Sequence[str], budget: int) -> DataFrame:
    """Extension: the rows of a sample whose text fits into `budget` characters per group.

    Tail rows come first, as they are nearest to the crash, then the middle, then the head; a
    row that does not fit ends the selection.  Meant for samples, whose groups are bounded.
    """
    place = F.when(F.col("section") == TAIL, 0).when(F.col("section") == MIDDLE, 1).otherwise(2)
    nearest = F.when(F.col("section") == TAIL, -F.col("pos_in_section")).otherwise(F.col("pos_in_section"))
    so_far = Window.partitionBy(*group).orderBy(place, nearest).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    used = sample.withColumn("used", F.sum(F.length("line") + 1).over(so_far))
    return used.where(F.col("used") <= budget)


def context_payload(sample: DataFrame, group: Sequence[str]) -> DataFrame:
    """The sample of each group as one redacted text."""
    rows = F.array_sort(F.collect_list(F.struct("pos_in_section", "section", "line")))
    grouped = sample.groupBy(*group).agg(
        rows.alias("rows"), F.max("group_lines").alias("group_lines"), F.count(F.lit(1)).alias("kept_lines")
    )

    def section(name):
        kept = F.filter(F.col("rows"), lambda r: r["section"] == name)
        return F.array_join(F.transform(kept, lambda r: r["line"]), "\n")

    cut = F.concat(
        section(HEAD),
        dropped_title(F.col("group_lines") - F.col("kept_lines")),
        section(MIDDLE),
        F.lit(P.CRASH_TITLE),
        section(TAIL),
    )
    whole = F.col("rows")[0]["section"] == ALL
    text = grouped.select(
        *group, "group_lines", "kept_lines", F.when(whole, section(ALL)).otherwise(cut).alias("payload")
    )
    return text.withColumn("payload", scrub_text(F.col("payload")))
