"""Top rows per group, safe for a group that holds most of the table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def join_groups(df: DataFrame, other: DataFrame, group: Sequence[str], how: str = "inner") -> DataFrame:
    """`df` with what `other` holds per group; null is a group like any other."""
    own = {c: f"_of_{i}" for i, c in enumerate(group)}
    named = other.select(*[F.col(f"`{c}`").alias(own.get(c, c)) for c in other.columns])
    same = reduce(lambda a, b: a & b, [df[f"`{c}`"].eqNullSafe(named[n]) for c, n in own.items()])
    return df.join(named, same, how).drop(*own.values())


def top_k_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    salts: int = 64,
) -> DataFrame:
    """The first `k` rows of each group in `order`, numbered from 1 in `rank`.

    `order` must be total.  Each input task keeps at most `k` rows per group
    before anything is shuffled.  Those go to `salts` tasks per group, and only
    the survivors meet in one task: at most ``k * salts`` rows, whatever the size
    of the group.  The salt follows the input partition, so it adds no rows; the
    result does not depend on it.

    Spark keeps only `k` rows of a task up to a limit on `k`; beyond it a group would be
    sorted as a whole, so a larger `k` is refused.
    """
    most = int(df.sparkSession.conf.get(_LIMIT))
    if k > most:
        raise ValueError(f"{k} rows per group; {_LIMIT} allows {most}")
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    first = Window.partitionBy(*group, "_salt").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    return (
        salted.withColumn(rank, F.row_number().over(first))
        .where(F.col(rank) <= k)
        .drop("_salt", rank)
        .withColumn(rank, F.row_number().over(final))
        .where(F.col(rank) <= k)
        .withColumn(rank, F.col(rank).cast("long"))
    )
