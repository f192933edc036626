"""What tests share."""


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def values_of(spark, column_of, texts):
    """The results of a column expression for some texts, in their order."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").coalesce(1)
    return [r["y"] for r in df.select("i", column_of(F.col("x")).alias("y")).orderBy("i").collect()]


def value_of(spark, column_of, text):
    return values_of(spark, column_of, [text])[0]
