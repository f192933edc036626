"""Extension: following a folder of text logs.

Files must be complete when they appear in the folder, as after a rename; a record does not
go on from one file to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logquarry.operators.stitch import stitch
from logquarry.schema import LOG_SCHEMA

_BATCH = "batch"


def tail_logs(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    on_bad: str = "quarantine",
    files_per_batch: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Parse new files of `folder` and add their records to the Parquet table `out`.

    Each micro-batch replaces a folder of its own, so a batch that is run again after a
    failure leaves its records once.  `trigger` takes the arguments of the writer's trigger;
    by default everything present is read and the query ends.
    """
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch keeps the rows of a split together and in order.
        ordered = batch.withColumn("seq", F.monotonically_increasing_id())
        stitch(ordered, on_bad=on_bad).write.mode("overwrite").parquet(f"{out}/{_BATCH}={batch_id}")

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def record_stream(spark: SparkSession, out: str, files_per_batch: int | None = None) -> DataFrame:
    """The records that `tail_logs` writes, as a stream.

    A batch of `tail_logs` that is run again after a failure writes new files, which a stream that has read the old ones
    reads too; let the tailing query end a batch before the stream starts on it where records must not come twice.
    """
    schema = T.StructType([*LOG_SCHEMA.fields, T.StructField(_BATCH, T.LongType())])
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(out)


def without_time(records: DataFrame) -> DataFrame:
    """The records that no window can hold, to be counted or kept elsewhere."""
    return records.where(F.col("timestamp").isNull())


def late_counts(query: StreamingQuery) -> int:
    """What a query over `windowed_error_rate` has left out as too late, over its recent batches: counts per app, window
    and task, each of one record or more.  Above 0, records were lost."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def windowed_error_rate(records: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Records and errors per app and time window.

    A window is given out once no record can fall into it any more, that is when a record
    more than `delay` past its end was seen.  A record that comes later than that is left out and counted by
    `late_counts`; one without a time is in no window, see `without_time`.  Watermarks need a time with a zone; the
    session zone is taken for both directions, and UTC is the setting to use.
    """
    timed = records.where(F.col("timestamp").isNotNull()).withColumn("at", F.col("timestamp").cast("timestamp_ltz"))
    counts = (
        timed.withWatermark("at", delay)
        .groupBy("app", F.window("at", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("level") == "ERROR").alias("errors"))
    )
    return counts.select(
        "app", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "records", "errors",
        F.round(F.col("errors") / F.col("records"), 6).alias("error_rate"),
    )


_COUNTS = f"app string, window_start timestamp_ntz, records long, errors long, last long, {_BATCH} long"


def count_and_keep_late(
    records: DataFrame, out: str, checkpoint: str, window: int = 3600, delay: int = 600, trigger: dict | None = None
) -> StreamingQuery:
    """Records and errors per app and window of `window` seconds, with a side table of the records that came too late.

    A window is closed once a batch has ended that saw a record more than `delay` seconds past the window's end.  What comes
    for it later, and records without a time, goes to the side table whole, so `window_totals` and `late_rows` add up to
    the input.  Whether a row is late follows from the latest time of the batches before, which each batch stores; so a batch that is run again
    after a failure replaces its folders by the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _latest(spark, out, batch_id - 1) if batch_id else None
        at = F.unix_micros(F.col("timestamp").cast("timestamp_ltz"))
        start = F.floor(at / (window * 1_000_000)) * window
        closed = F.lit(False) if before is None else (start + window) * 1_000_000 <= before - delay * 1_000_000
        late = F.col("timestamp").isNull() | closed
        rows = batch.drop(_BATCH)
        rows.where(late).write.mode("overwrite").parquet(f"{out}/late/{_BATCH}={batch_id}")
        counts = rows.where(~late).groupBy("app", F.timestamp_seconds(start).cast("timestamp_ntz").alias("window_start")).agg(
            F.count(F.lit(1)).alias("records"), F.count_if(F.col("level") == "ERROR").alias("errors"), F.max(at).alias("last")
        )
        of_batch = f"{out}/counts/{_BATCH}={batch_id}"
        counts.write.mode("overwrite").parquet(of_batch)
        latest = spark.read.schema(_COUNTS).parquet(of_batch).agg(F.greatest(F.max("last"), F.lit(before).cast("long")).alias("latest"))
        latest.write.mode("overwrite").parquet(f"{out}/latest/{_BATCH}={batch_id}")

    return (
        records.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _latest(spark: SparkSession, out: str, batch_id: int) -> int | None:
    """The latest time, in microseconds, that a batch or one before it has seen."""
    return spark.read.schema("latest long").parquet(f"{out}/latest/{_BATCH}={batch_id}").first()["latest"]


def window_totals(spark: SparkSession, out: str) -> DataFrame:
    """What `count_and_keep_late` has counted: app, window_start, records, errors, error_rate.  The latest windows may still grow."""
    counts = spark.read.schema(_COUNTS).parquet(f"{out}/counts")
    sums = counts.groupBy("app", "window_start").agg(F.sum("records").alias("records"), F.sum("errors").alias("errors"))
    return sums.withColumn("error_rate", F.round(F.col("errors") / F.col("records"), 6))


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """The records that `count_and_keep_late` has kept apart, with the batch that brought them."""
    schema = T.StructType([*LOG_SCHEMA.fields, T.StructField(_BATCH, T.LongType())])
    return spark.read.schema(schema).parquet(f"{out}/late")
