"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` worked out a single time, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
