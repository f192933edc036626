"""Extension: what a role may see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.functions.redaction import scrub
from logquarry.operators.ranking import join_groups


def visible_to(logs: DataFrame, role: str, grants: DataFrame, hidden: DataFrame) -> DataFrame:
    """The records and columns of `logs` open to `role`.

    `grants(role, app)` lists the apps a role may read, and `hidden(role, column_name)` the
    columns it may not.  The list of columns is bounded by the schema.  A role without
    grants sees nothing; a grant of the null app opens the records without one.  The result is redacted.
    """
    closed = {r[0] for r in hidden.where(F.col("role") == role).select("column_name").distinct().collect()}
    allowed = grants.where(F.col("role") == role).select("app").distinct()
    seen = join_groups(logs, allowed, ["app"], "left_semi")
    return scrub(seen.select(*[c for c in logs.columns if c not in closed]))
