"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.session import settle

FEW = 1 << 16  # ties, of 16 bytes or a few more, that one task holds; dealing out so few takes longer than the work


def components(pairs: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, root (the smallest node that it reaches) for all nodes of ``pairs`` (a, b).

    Large-star and small-star rounds in turn: each node's neighbours are tied to its smallest one, until all ties go
    to roots.  Every round is written to the shared folder, which cuts the lineage.  Once there are ``FEW`` ties or less, a
    round is one task; more are dealt out.
    """
    ties = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    ties = settle(ties, "ties")
    rows, before = ties.count(), None
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    for _ in range(most_rounds):
        both = (ties.coalesce(1) if rows <= FEW else ties).select(F.explode(ends).alias("t")).select("t.u", "t.v")
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        two = F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        small = large.join(lowest, "u").select(F.explode(two).alias("t")).select("t.u", "t.v")
        ties = settle(small.where("u <> v").distinct(), "ties")
        now = ties.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38)"))).first()
        if now == before:
            return ties.select(F.col("u").alias("node"), F.col("v").alias("root")).union(ties.select("v", "v").distinct())
        before, rows = now, now[0]
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
