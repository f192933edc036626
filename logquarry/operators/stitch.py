"""Lines to records (S2), without reading any file whole.

Lines carry an order key ``(file, block, seq)``; a block is one input split.
The lines are shuffled once, by ``(file, block)``.  Inside a block a running
count of headers numbers the records, and grouping by that number needs no second
shuffle.  Only what crosses a block border moves again: the lines before the
first header of a block belong to the last record of an earlier one.  That side
table holds one row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions import lines as L
from logquarry.functions.expressions import once
from logquarry.schema import LOG_COLUMNS, ROW_ID


def _in_order(items, text: str):
    """Join the text of ordered structs with line feeds; null when there are none."""
    return F.when(
        F.size(items) > 0, F.array_join(F.transform(F.array_sort(items), lambda x: x[text]), "\n")
    )


def split_to_lines(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, each in one row, with the headers among them marked."""
    return (
        lines.select("file", "block", "seq", F.posexplode(L.split_lines(F.col("value"))).alias("pos", "line"))
        .where(L.is_not_blank(F.col("line")))
        .select("file", "block", "seq", "pos", L.mark_header(F.col("line")).alias("line"))
    )


def stitch(
    lines: DataFrame,
    on_bad: str = "fail",
    row_ids: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """`lines(file, block, seq, value)` to the six log columns.

    `seq` orders the lines of a block and `block` the blocks of a file; both
    may be any sortable type.  Blank lines are dropped, lines that are not
    headers join the record before them, and lines before the first record of a
    file are dropped.  `row_ids` adds a zero-based number in (file, position)
    order; `keep` may name ``file`` to keep it in the result.
    """
    # Everything below starts from this one shuffle.  What is taken from a line is worked
    # out after it, so that each use needs the same columns and the shuffle is shared.
    # Its number of parts is fixed, because small ones that are joined up to a size of compressed
    # bytes may hold many times as much memory; every window below sorts what a part holds.
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = split_to_lines(lines).repartition(parts, "file", "block")
    in_block = Window.partitionBy("file", "block").orderBy("seq", "pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    header = L.is_header(F.col("line"))
    numbered = marked.withColumn("rec", F.sum(F.when(header, 1).otherwise(0)).over(in_block))
    place = F.struct("seq", "pos", "line")

    records = (
        numbered.where(F.col("rec") > 0)
        .groupBy("file", "block", "rec")
        .agg(
            F.max(F.when(header, F.col("line"))).alias("header"),
            F.collect_list(F.when(~header, place)).alias("rest"),
        )
        .select("file", "block", "rec", "header", _in_order(F.col("rest"), "line").alias("rest"))
    )

    blocks = numbered.groupBy("file", "block").agg(F.max("rec").alias("n"))
    by_file = Window.partitionBy("file").orderBy("block")
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("n") > 0, F.struct("block", "n")), ignorenulls=True).over(earlier)
    owned = blocks.select(
        F.col("file").alias("l_file"), F.col("block").alias("l_block"), owner.alias("owner")
    ).where(F.col("owner").isNotNull())
    # Lines before a block's first header; those that no record owns are dropped before any are gathered.
    lead = numbered.where(F.col("rec") == 0)
    carried = (
        lead.join(owned, (F.col("file") == F.col("l_file")) & (F.col("block") == F.col("l_block")))
        .groupBy("file", "owner")
        .agg(F.collect_list(F.struct("block", "seq", "pos", "line")).alias("lead"))
        .select(
            F.col("file").alias("c_file"),
            F.col("owner.block").alias("c_block"),
            F.col("owner.n").alias("c_rec"),
            _in_order(F.col("lead"), "line").alias("carry"),
        )
    )
    out = records.join(
        carried, (F.col("file") == F.col("c_file")) & (F.col("block") == F.col("c_block")), "left"
    )
    if row_ids:
        out = out.join(_block_offsets(blocks), ["file", "block"])

    carry = F.when(F.col("rec") == F.col("c_rec"), F.col("carry"))
    chosen = [F.col(c) for c in keep]
    if row_ids:
        chosen.append((F.col("offset") + F.col("rec") - 1).alias(ROW_ID))
    return out.select(*chosen, *_log_fields(on_bad, F.col("rest"), carry))


def _log_fields(on_bad: str, *more_text) -> list:
    """The six log columns of a row with a marked `header`; `more_text` continues the message."""
    fields = L.header_fields(F.col("header"))
    fields["timestamp"] = L.typed(fields["timestamp"], "timestamp_ntz", on_bad, "timestamp")
    fields["line_number"] = L.typed(fields["line_number"], "bigint", on_bad, "line number")
    fields["message"] = F.concat_ws("\n", fields["message"], *more_text)
    return [fields[c].alias(c) for c in LOG_COLUMNS]


def _block_offsets(blocks: DataFrame) -> DataFrame:
    """Records before each block.  Summed inside each file, then over files; the
    second step is the only one in a single task and sees one row per file."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("n").alias("total"))
    all_files = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("total").over(all_files), F.lit(0)).alias("base"))
    return (
        blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("inside"))
        .join(bases, "file")
        .select("file", "block", (F.col("base") + F.col("inside")).alias("offset"))
    )


def parse_texts(df: DataFrame, text: str, on_bad: str = "fail", keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse a column whose every value is a log of its own.  Nothing is shuffled.

    `keep` names columns to repeat on each record.
    """

    def records(lines):
        starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: L.is_header(F.element_at(lines, i)))

        def cut(starts):
            def record(start, k):
                end = F.coalesce(F.get(starts, k + 1), F.size(lines) + 1)
                more = F.slice(lines, start + 1, end - start - 1)
                return F.struct(
                    F.element_at(lines, start).alias("header"),
                    F.when(F.size(more) > 0, F.array_join(more, "\n")).alias("rest"),
                )

            return F.transform(starts, record)

        # A sequence from 1 to 0 would count down.
        return F.when(F.size(lines) > 0, once(starts, cut))

    lines = F.transform(F.filter(L.split_lines(F.col(text)), L.is_not_blank), L.mark_header)
    found = df.select(*keep, F.explode(once(lines, records)).alias("r")).select(*keep, "r.*")
    return found.select(*keep, *_log_fields(on_bad, F.col("rest")))


def parse_lines(
    df: DataFrame,
    seq: str,
    text: str = "value",
    file: str | None = None,
    block_bits: int = 16,
    on_bad: str = "fail",
    keep_file: bool = False,
) -> DataFrame:
    """Parse logs whose lines are spread over rows, one line or many per row.

    `seq` is a whole number that orders the rows of one `file`; rows without it come first, and rows that share one
    keep their lines together and follow the order of their text.  Rows are cut into blocks of
    ``2 ** block_bits`` by `seq`, so that one large log is spread over many tasks.  Rows
    without a file form one log.
    """
    # Keys that cannot be null keep the planner from filtering one use of the lines and
    # not the other, which would cost a second shuffle.
    position = F.col(seq).cast("long")
    name = F.coalesce(F.col(file).cast("string"), F.lit("")) if file else F.lit("")
    # Rows of one position stay apart, in the order of their text.
    place = F.struct(position.alias("position"), F.xxhash64(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    source = df.select(
        name.alias("file"), F.coalesce(F.shiftright(position, block_bits), F.lit(_BEFORE_ALL)).alias("block"),
        place.alias("seq"), F.col(text).alias("value"),
    )
    return stitch(source, on_bad=on_bad, keep=("file",) if keep_file else ())


_BEFORE_ALL = -(1 << 62)
