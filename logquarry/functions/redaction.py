"""Redaction of tokens, keys, e-mail and IP addresses.

Redaction is the last projection of a result.  Putting it under a filter or a
grouping would change which rows match, and would keep the filter from reaching
the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.functions import patterns as P

# Cheap test a text must pass before the four expressions can change it: an
# address needs a dotted run of numbers.
_DOTTED = r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"

# The same e-mail pattern, told not to give characters back: none of them can be the "@" that
# must follow, and trying costs as much again on every word.
_EMAIL = P.java(P.EMAIL.replace("]+@", "]++@"))


def _may_hold_secret(text: Column) -> Column:
    """False only for texts that none of the four patterns matches.

    Long s folds to "s" but stays itself in lower case, so it is let through.
    """
    lower = F.lower(text)
    return (
        text.contains("@")
        | text.contains("eyJ")
        | lower.contains("key")
        | lower.contains("token")
        | lower.contains("secret")
        | lower.contains("bearer")
        | text.contains("\u017f")
        | text.rlike(_DOTTED)
    )


_STEPS = (
    ("jwt", P.java(P.JWT), P.JWT_MARK),
    ("api_key", P.java(P.API_KEY, True), "$1" + P.API_KEY_MARK),
    ("email", _EMAIL, P.EMAIL_MARK),
    ("ip", P.java(P.IPV4), P.IPV4_MARK),
)


def scrub_text(text: Column) -> Column:
    """`text` with secrets replaced: JWT, then key, then e-mail, then IPv4.

    Null stays null.  Most texts hold nothing to redact; they pay for a few
    substring searches instead of four regular expressions.
    """
    clean = text
    for _, pattern, mark in _STEPS:
        clean = F.regexp_replace(clean, F.lit(pattern), F.lit(mark))
    return F.when(_may_hold_secret(text), clean).otherwise(text)


def _deep(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return scrub_text(value)
    if isinstance(data_type, T.ArrayType) and _has_string(data_type):
        return F.transform(value, lambda x: _deep(x, data_type.elementType))
    if isinstance(data_type, T.MapType) and _has_string(data_type.valueType):
        return F.transform_values(value, lambda _, v: _deep(v, data_type.valueType))
    if isinstance(data_type, T.StructType) and _has_string(data_type):
        fields = [_deep(value.getField(f.name), f.dataType).alias(f.name) for f in data_type]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _has_string(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.StringType):
        return True
    if isinstance(data_type, T.ArrayType):
        return _has_string(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return _has_string(data_type.valueType)
    if isinstance(data_type, T.StructType):
        return any(_has_string(f.dataType) for f in data_type)
    return False


def scrub(df: DataFrame, columns: Sequence[str] | None = None, deep: bool = False) -> DataFrame:
    """Redact `columns`, by default every string column; the others pass unchanged.

    Strings inside arrays, structs and map values pass unredacted unless `deep`
    is set.  Map keys are never rewritten: two keys could become one.
    """
    if columns is not None:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"no such column: {', '.join(missing)}")
    out = []
    for field in df.schema:
        value = df[f"`{field.name}`"]
        if columns is not None and field.name not in columns:
            out.append(value)
        elif isinstance(field.dataType, T.StringType):
            out.append(scrub_text(value).alias(field.name))
        elif deep and _has_string(field.dataType):
            out.append(_deep(value, field.dataType).alias(field.name))
        else:
            out.append(value)
    return df.select(*out)


def redaction_counts(text: Column) -> Column:
    """How many replacements of each kind `scrub_text` makes: each is counted on what the ones before it leave."""
    counts, clean = [], text
    for kind, pattern, mark in _STEPS:
        counts.append(F.regexp_count(clean, F.lit(pattern)).cast("long").alias(kind))
        clean = F.regexp_replace(clean, F.lit(pattern), F.lit(mark))
    return F.struct(*counts)
