"""Table profiles and descriptions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.functions import patterns as P
from logquarry.functions.redaction import scrub, scrub_text

_UNORDERED = (T.MapType, T.VariantType)


def profile(df: DataFrame, exact: Sequence[str] = ()) -> DataFrame:
    """One row per column: type, rows, nulls, distinct values, whether these are exact, min and max.

    Distinct values are counted exactly for the columns named in `exact`, which should have few, and estimated for
    the others.  All columns are measured in one aggregation; the wide row is then unpivoted.  Extremes are shown as
    redacted text.
    """
    measures = []
    for i, field in enumerate(df.schema):
        value = F.col(f"`{field.name}`")
        comparable, listed = not isinstance(field.dataType, _UNORDERED), field.name in exact
        distinct = F.count_distinct(value) if listed else F.approx_count_distinct(value)
        extreme = lambda pick: pick(value).cast("string") if comparable else F.lit(None).cast("string")
        measures.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("column_type"),
                F.count(F.lit(1)).alias("row_count"),
                (F.count(F.lit(1)) - F.count(value)).alias("null_count"),
                (distinct if comparable else F.lit(None).cast("long")).alias("distinct_count"),
                F.lit(listed).alias("distinct_exact"),
                extreme(F.min).alias("min_value"),
                extreme(F.max).alias("max_value"),
            ).alias(f"c{i}")
        )
    unpivoted = df.agg(*measures).select(F.inline(F.array(*[f"c{i}" for i in range(len(measures))])))
    return scrub(unpivoted, ["min_value", "max_value"])


def sample_rows(df: DataFrame, order: Iterable[str | Column], k: int = P.SAMPLE_ROWS) -> DataFrame:
    """The first `k` rows in a total order, redacted."""
    return scrub(df.orderBy(*order).limit(k))


def describe_tables(
    spark: SparkSession, names: Sequence[str], tables: Mapping[str, DataFrame], order: Mapping[str, list[str]],
    k: int = P.SAMPLE_ROWS,
) -> DataFrame:
    """One row per name: table_name, columns (name and type), sample (the first `k` rows by `order`, redacted, a line
    each), problem (set for a name that stands for no table)."""
    return reduce(DataFrame.unionByName, [_describe(spark, n, tables.get(n), order.get(n), k) for n in names])


def _describe(spark: SparkSession, name: str, df: DataFrame | None, order: list[str] | None, k: int) -> DataFrame:
    said = [F.lit(name).alias("table_name"), F.lit(None).cast("string").alias("problem")]
    if df is None:
        unknown = [F.lit(None).cast("string").alias(c) for c in ("columns", "sample")]
        return spark.range(1).select(said[0], F.lit(f"{name} is not among the tables").alias("problem"), *unknown)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    keys = order or [c for c, t in zip(df.columns, df.schema) if not isinstance(t.dataType, _UNORDERED)]
    shown = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")) for c in df.columns]
    first = df.orderBy(*keys).limit(k).select(
        F.struct(*keys).alias("place"), scrub_text(F.concat_ws(" | ", *shown)).alias("line")
    )
    lines = F.array_sort(F.collect_list(F.struct("place", "line")))
    text = F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("sample")
    return first.agg(text).select(*said, F.lit(columns).alias("columns"), "sample")
