import os
import time

import pytest
from helpers import rows
from pyspark.sql import functions as F

from logquarry.operators import access
from logquarry.operators import query as S
from logquarry.operators.sampling import within_budget
from logquarry.plans.incidents import alert_reports
from logquarry.session import scratch_path, settle
from logquarry.streaming import tail


def write_log(folder, name, first, n=20):
    text = "".join(
        f"2026-08-01 {first % 24:02d}:{i:02d}:00 [{'ERROR' if i % 4 == 0 else 'INFO'}] app (f.py:{first + i}): m\n  more\n"
        for i in range(n)
    )
    staged = folder.parent / name
    staged.write_text("orphan\n" + text)
    os.rename(staged, folder / name)


def test_tailing_goes_on_where_it_stopped(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def follow():
        tail.tail_logs(spark, str(folder), out, checkpoint, files_per_batch=1).awaitTermination()
        return sorted(r[0] for r in rows(spark.read.parquet(out), "line_number"))

    write_log(folder, "a.log", 0)
    write_log(folder, "b.log", 100)
    assert follow() == [*range(20), *range(100, 120)]
    # Nothing new, then one more file.
    assert len(follow()) == 40
    write_log(folder, "c.log", 200)
    assert follow() == [*range(20), *range(100, 120), *range(200, 220)]
    assert {m for (m,) in rows(spark.read.parquet(out), "message")} == {"m\n  more"}


def test_a_repeated_batch_leaves_its_records_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_log(folder, "a.log", 0)
    out = str(tmp_path / "out")
    for attempt in ("first", "again"):
        # A lost checkpoint starts over with batch 0, as a batch that failed after writing does.
        tail.tail_logs(spark, str(folder), out, str(tmp_path / attempt)).awaitTermination()
        assert spark.read.parquet(out).count() == 20


def test_windows_wait_for_the_watermark(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, hour in enumerate((1, 2, 3)):
        write_log(folder, f"{i}.log", hour)
    out, result = str(tmp_path / "out"), str(tmp_path / "rates")
    tail.tail_logs(spark, str(folder), out, str(tmp_path / "c1")).awaitTermination()
    rates = tail.windowed_error_rate(tail.record_stream(spark, out))
    rates.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c2")).trigger(
        availableNow=True
    ).start(result).awaitTermination()
    found = sorted(rows(spark.read.parquet(result)))
    assert [(str(w), n, e, r) for _, w, n, e, r in found] == [
        ("2026-08-01 01:00:00", 20, 5, 0.25), ("2026-08-01 02:00:00", 20, 5, 0.25),
    ]


def test_late_and_timeless_records_are_counted(spark, tmp_path):
    out = str(tmp_path / "records")
    for i, hour in enumerate((1, 9, 15, 2)):
        df = spark.range(4).select(
            F.when(F.col("id") > 0, F.lit(f"2031-01-01 {hour:02d}:00:00")).cast("timestamp_ntz").alias("timestamp"), F.lit("INFO").alias("level"),
            F.lit("a").alias("app"), F.lit("f").alias("source_file"), F.lit(1).cast("bigint").alias("line_number"), F.lit("m").alias("message"),
        )
        df.coalesce(1).write.parquet(f"{out}/batch={i}")
        time.sleep(1.1)  # files are read in the order of their times
    records = tail.record_stream(spark, out, files_per_batch=1)
    query = tail.windowed_error_rate(records).writeStream.format("memory").queryName("late").trigger(availableNow=True).start()
    query.awaitTermination()
    assert tail.late_counts(query) == 1  # three records of one window
    assert tail.without_time(spark.read.parquet(out)).count() == 4


def test_late_records_are_kept_apart(spark, tmp_path):
    """Windows and side table add up to the input, also when all batches are run again."""
    source, out = str(tmp_path / "records"), str(tmp_path / "windows")
    for i, hour in enumerate((1, 9, 15, 2, 15)):
        df = spark.range(4).select(
            F.when(F.col("id") > 0, F.lit(f"2031-01-01 {hour:02d}:00:00")).cast("timestamp_ntz").alias("timestamp"),
            F.when(F.col("id") == 1, "ERROR").otherwise("INFO").alias("level"), F.when(F.col("id") > 1, "a").alias("app"),
            F.lit("f").alias("source_file"), F.col("id").alias("line_number"), F.lit("m").alias("message"),
        )
        df.coalesce(1).write.parquet(f"{source}/batch={i}")
        time.sleep(1.1)  # files are read in the order of their times
    for attempt in ("c1", "c2"):
        records = tail.record_stream(spark, source, files_per_batch=1)
        tail.count_and_keep_late(records, out, str(tmp_path / attempt)).awaitTermination()
        totals = sorted((str(w), a or "", n, e, r) for a, w, n, e, r in rows(tail.window_totals(spark, out)))
        assert totals == [
            (f"2031-01-01 {h:02d}:00:00", a, n * k, n * (a == ""), 1.0 if a == "" else 0.0)
            for h, n in ((1, 1), (9, 1), (15, 2)) for a, k in (("", 1), ("a", 2))
        ]
        late = tail.late_rows(spark, out)
        assert late.where("timestamp is null").count() == 5
        assert sorted(rows(late.where("timestamp is not null"), "line_number", "batch")) == [(1, 3), (2, 3), (3, 3)]


def test_recorded_query(spark, tmp_path):
    logs = spark.createDataFrame([(1, "a@b.cc"), (2, "x"), (3, None)], "n long, message string")
    out, journal = str(tmp_path / "out"), str(tmp_path / "journal")
    found = S.run_recorded(spark, "SELECT * FROM {logs}", out, journal, logs=logs)
    assert sorted(rows(found)) == [(1, "[REDACTED_EMAIL]"), (2, "x"), (3, None)]
    S.run_recorded(spark, "SELECT * FROM {logs} WHERE n > ?", out + "2", journal, "sql", (5,), logs=logs)
    entries = rows(spark.read.parquet(journal).where("error is null").orderBy("started"), "route", "row_count", "redacted")
    assert entries == [("sql", 3, 1), ("sql", 0, 0)]
    with pytest.raises(ValueError):
        S.run_recorded(spark, "DROP TABLE logs", out + "3", journal)
    failed = spark.read.parquet(journal).where("error is not null").collect()
    assert [(r["query"], r["row_count"]) for r in failed] == [("DROP TABLE logs", None)]


def test_roles(spark):
    logs = spark.createDataFrame([("a", "m1"), ("b", "to a@b.cc"), (None, "m3")], "app string, message string")
    grants = spark.createDataFrame([("dev", "a"), ("dev", "a"), ("ops", "b")], "role string, app string")
    hidden = spark.createDataFrame([("dev", "message")], "role string, column_name string")
    assert rows(access.visible_to(logs, "dev", grants, hidden)) == [("a",)]
    assert rows(access.visible_to(logs, "ops", grants, hidden)) == [("b", "to [REDACTED_EMAIL]")]
    assert access.visible_to(logs, "guest", grants, hidden).count() == 0


def test_budget_prefers_the_tail(spark):
    sample = spark.createDataFrame(
        [("g", s, i, "x" * 9) for s in ("head", "middle", "tail") for i in (1, 2, 3)],
        "g string, section string, pos_in_section long, line string",
    )
    kept = sorted(rows(within_budget(sample, ["g"], 45), "section", "pos_in_section"))
    assert kept == [("middle", 1), ("tail", 1), ("tail", 2), ("tail", 3)]


def test_alerts_only_for_bad_days(spark):
    logs = spark.range(100).select(
        F.col("id").alias("_rowid"),
        F.when(F.col("id") < 50, F.lit("2026-01-01")).otherwise(F.lit("2026-01-02")).cast("timestamp_ntz").alias("timestamp"),
        F.when((F.col("id") < 30) | (F.col("id") == 99), "ERROR").otherwise("INFO").alias("level"),
        F.lit("a").alias("app"), F.lit("m").alias("message"),
    )
    found = rows(alert_reports(logs, 0.5))
    assert [s for s, _ in found] == ["a on 2026-01-01"] and "30 failed records" in found[0][1]


def test_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = settle(docs.groupBy("lang").count(), "langs")
    assert sorted(rows(counts)) == sorted(rows(docs.groupBy("lang").count()))
    plan = docs.join(counts, "lang")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
