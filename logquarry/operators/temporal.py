"""Extension: joins along time, in buckets, so that neither a group nor the whole table is one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.operators.ranking import join_groups


def _bucket(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(at.cast("timestamp_ltz")) / seconds)


def _check_names(left: DataFrame, keep: Sequence[str]) -> None:
    both = sorted(set(left.columns) & set(keep))
    if both:
        raise ValueError(f"columns of both sides: {', '.join(both)}")


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], time: str, tie: str, keep: Sequence[str], bucket: int = 3600
) -> DataFrame:
    """Every row of `left` with the columns `keep` of the last row of `right` of the same group before it, or nulls.

    Both have `by`, `time` and `tie`, which orders rows of one time; (time, tie) must be total in a group of `right`.  Null is a
    group like any other.  A row without a time has none before it and is before none.

    Rows of both sides meet by group and bucket of `bucket` seconds, where the last one seen is carried along.  What a
    bucket begins with is carried from bucket to bucket, on one row for each.
    """
    _check_names(left, keep)
    columns = [*by, time, tie]
    row, found = F.struct(*[F.col(f"`{c}`") for c in left.columns]), F.struct(*[F.col(f"`{c}`") for c in keep])
    # Of one time and tie, a row of the left stands first: what it finds is strictly before it.
    asked = left.select(*columns, F.lit(0).alias("_side"), row.alias("_row"))
    given = right.where(F.col(time).isNotNull()).select(*columns, F.lit(1).alias("_side"), found.alias("_found"))
    both = asked.where(F.col(time).isNotNull()).unionByName(given, allowMissingColumns=True)
    both = both.withColumn("_bucket", _bucket(F.col(time), bucket))
    so_far = Window.partitionBy(*by, "_bucket").orderBy(time, tie, "_side").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.last("_found", ignorenulls=True).over(so_far)).where("_side = 0")
    place = F.when(F.col("_side") == 1, F.struct(time, tie))
    ends = both.groupBy(*by, "_bucket").agg(F.max_by("_found", place).alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select(*by, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_far"))
    joined = join_groups(near, begins, [*by, "_bucket"]).select("_row", F.coalesce("_near", "_far").alias("_found"))
    timeless = asked.where(F.col(time).isNull()).select("_row")
    return joined.unionByName(timeless, allowMissingColumns=True).select("_row.*", *[f"_found.`{c}`" for c in keep])


def overlap_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str],
    keep: Sequence[str], bucket: int = 3600,
) -> DataFrame:
    """Every pair of rows of one group whose spans overlap: the columns of `left`, and `keep` of `right`.

    A span is two columns, its first and its last moment, both part of it; a point in time is a column named twice.  Null is
    a group like any other.  Spans without a first or last moment, or that end before they begin, overlap nothing.

    A span is laid into each bucket of `bucket` seconds that it touches, and a pair comes out of the first that both
    touch, so there are no pairs to be made different.  Take buckets about as long as most spans.
    """
    _check_names(left, keep)

    def laid(df: DataFrame, span: tuple[str, str], columns: Sequence[str], x: str) -> DataFrame:
        first, last = (F.col(f"`{c}`") for c in span)
        touched = F.sequence(_bucket(first, bucket), _bucket(last, bucket))
        return df.where(first <= last).select(
            *by, first.alias(f"_{x}first"), last.alias(f"_{x}last"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias(f"_{x}"),
            F.explode(touched).alias("_bucket"),
        )

    pairs = join_groups(laid(left, left_span, left.columns, "l"), laid(right, right_span, keep, "r"), [*by, "_bucket"])
    overlap = (F.col("_lfirst") <= F.col("_rlast")) & (F.col("_rfirst") <= F.col("_llast"))
    first = F.greatest(_bucket(F.col("_lfirst"), bucket), _bucket(F.col("_rfirst"), bucket))
    return pairs.where(overlap & (F.col("_bucket") == first)).select("_l.*", *[f"_r.`{c}`" for c in keep])
