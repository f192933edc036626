import datetime as dt

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def docs(spark):
    """Makes a documents table of texts, or of (doc_id, text)."""

    def make(rows, parts=3):
        full = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(*r, "en", f"src{i % 3}", len(r[1] or ""))[:5] if len(r) == 2 else r for i, r in enumerate(full)]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


@pytest.fixture
def clashing():
    """Adds columns with names an operator might use itself."""
    from pyspark.sql import functions as F

    names = "n_words kept fingerprint component_id shard slot line key n rank score label spans size lines row".split()

    def add(df):
        return df.select("*", *[F.lit(dt.date(2024, 1, 1)).alias(n) for n in names if n not in df.columns])

    return add
