import json
import uuid

import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.operators import validate as V
from logquarry.session import shared_folder
from logquarry.sources.store import LogStore, with_row_ids
from logquarry.sources.tables import bad_records, read_table_file

COLUMNS = "timestamp string, level string, app string, source_file string, line_number long, message string"
SAMPLE = [
    ("2031-03-04 10:00:00", "INFO", "night_job", "load.py", 10, "copy begun"),
    ("2031-03-04 10:01:00", "ERROR", "night_job", "load.py", 42, "copy stopped"),
    ("2031-03-05 10:02:00", "ERROR", "night_job", "sort.py", 105, "for jo.roe@example.com"),
]


@pytest.fixture
def sample(spark):
    return spark.createDataFrame(SAMPLE, COLUMNS).coalesce(1)


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "store"), "logs_" + uuid.uuid4().hex)


def count(store):
    return store.df().count()


def test_second_insert_is_ignored(store, sample):
    store.insert(sample)
    store.insert(sample)
    assert count(store) == 3
    assert sorted(rows(store.df(), "_rowid", "line_number")) == [(0, 10), (1, 42), (2, 105)]


def test_append_numbers_on_and_overwrite_starts_again(store, sample):
    store.insert(sample)
    store.delete_record("1")
    store.insert(sample, mode="append")
    assert sorted(r[0] for r in rows(store.df(), "_rowid")) == [0, 2, 3, 4, 5]
    store.insert(sample, mode="overwrite")
    assert sorted(r[0] for r in rows(store.df(), "_rowid")) == [0, 1, 2]
    with pytest.raises(ValueError):
        store.insert(sample, mode="upsert")


def test_empty_frame_gives_empty_table(store, sample):
    store.insert(sample.limit(0))
    assert count(store) == 0
    assert store.get_by_id("0").count() == 0
    store.delete_filter("level = 'ERROR'")


def test_unsupported_data(store, tmp_path):
    with pytest.raises(ValueError):
        store.insert(12345)
    log = tmp_path / "pipeline.log"
    log.write_text("x\n")
    with pytest.raises(ValueError, match="no reader for '.log'"):
        store.insert(log)
    with pytest.raises(FileNotFoundError):
        store.insert(tmp_path / "none.csv")
    with pytest.raises(FileNotFoundError):
        store.ingest_log_file(tmp_path / "none.log")


def test_ids(store, sample):
    store.insert(sample)
    (found,) = store.get_by_id("2").collect()
    assert found["message"] == "for [REDACTED_EMAIL]"
    for missing in ("9999", "not-a-rowid", "01", "-1", "", "1.0", "١", "9" * 40):
        assert store.get_by_id(missing).count() == 0
        store.delete_record(missing)
    assert count(store) == 3
    store.delete_record("0")
    assert sorted(rows(store.df(), "_rowid", "line_number")) == [(1, 42), (2, 105)]


def test_delete_filter(store, sample):
    store.insert(sample.unionByName(sample.withColumn("level", F.lit(None).cast("string"))))
    for bad in ("", "  ", "true; select 1", "true -- x"):
        with pytest.raises(ValueError):
            store.delete_filter(bad)
    store.delete_filter("level = 'FATAL'")
    assert count(store) == 6
    store.delete_filter("level = 'ERROR'")
    # A condition that is neither true nor false keeps the row.
    assert sorted(rows(store.df(), "line_number")) == [(10,), (10,), (42,), (105,)]


def test_a_failing_source_leaves_the_old_rows(spark, store, sample):
    store.insert(sample)
    broken = sample.withColumn("level", F.when(F.col("line_number") == 42, F.raise_error(F.lit("lost source"))).otherwise("X"))
    with pytest.raises(Exception, match="lost source"):
        store.insert(broken, mode="overwrite")
    assert sorted(rows(store.df(), "_rowid", "level")) == [(0, "INFO"), (1, "ERROR"), (2, "ERROR")]
    again = LogStore(spark, store.path.rsplit("/", 1)[0], store.table)
    assert count(again) == 3
    again.insert(sample.limit(1), mode="overwrite")
    assert count(again) == 1


def forget(spark, store):
    """The catalog of a new session knows neither the view nor its tables."""
    spark.sql(f"DROP VIEW {store.table}")
    for row in spark.sql(f"SHOW TABLES LIKE '{store.table}__v*'").collect():
        spark.sql(f"DROP TABLE {row['tableName']}")


def reopened(spark, store):
    return LogStore(spark, store.path.rsplit("/", 1)[0], store.table)


@pytest.mark.parametrize("cut", ["_create", "_show"])
def test_a_delete_that_broke_off_is_done_or_not(spark, store, sample, monkeypatch, cut):
    """Without its version entered it has done nothing; once entered it is done, shown or not."""
    store.insert(sample)
    monkeypatch.setattr(LogStore, cut, lambda *a: (_ for _ in ()).throw(OSError("lost driver")))
    with pytest.raises(OSError):
        store.delete_filter("line_number in (10, 105)")
    monkeypatch.undo()
    left = [(10,), (42,), (105,)] if cut == "_create" else [(42,)]
    assert sorted(rows(reopened(spark, store).df(), "line_number")) == left
    forget(spark, store)
    assert sorted(rows(reopened(spark, store).df(), "line_number")) == left
    store.insert(sample.limit(1), mode="append")
    assert count(store) == len(left) + 1


def test_half_a_version_is_none(spark, store, sample):
    store.insert(sample)
    store._create(f"{store.path}/versions/2", '{"schema": {"ty')
    forget(spark, store)
    again = reopened(spark, store)
    assert count(again) == 3
    again.delete_record("0")
    assert count(again) == 2 and again._numbers() == [1, 2, 3]


def test_a_reader_keeps_its_version(spark, store, sample):
    store.insert(sample)
    reader = store.df()
    for write in (
        lambda: store.insert(sample, mode="append"), lambda: store.delete_filter("level = 'INFO'"),
        lambda: store.insert(sample.limit(1), mode="overwrite"),
    ):
        before, reader = count(store), store.df()
        write()
        assert reader.count() == before != count(store)


def test_a_reader_opened_in_the_middle_sees_the_old_rows(spark, store, sample, monkeypatch):
    store.insert(sample)
    commit, seen = LogStore._commit, []

    def opened(self, *args):
        seen.append(count(reopened(spark, store)))
        commit(self, *args)
        seen.append(count(reopened(spark, store)))

    monkeypatch.setattr(LogStore, "_commit", opened)
    store.insert(sample, mode="append")
    store.delete_filter("level = 'ERROR'")
    store.insert(sample.limit(1), mode="overwrite")
    assert seen == [3, 6, 6, 2, 2, 1]


def test_a_table_of_another_shape_is_refused(store, sample):
    store.insert(sample)
    with pytest.raises(ValueError, match="do not match"):
        store.insert(sample.drop("app"), mode="append")
    store.insert(sample.select(*reversed(sample.columns)), mode="append")
    assert sorted(r[0] for r in rows(store.df(), "app")) == ["night_job"] * 6


def test_vacuum_takes_what_was_deleted(spark, store, sample, tmp_path):
    store.insert(sample)
    store.insert(sample, mode="append")
    store.delete_filter("line_number = 42")
    store.delete_filter("line_number = 105")
    files = lambda: {str(p.relative_to(store.path)) for p in tmp_path.rglob("*.parquet")}
    before, kept = files(), sorted(rows(store.df()))
    used = {r[0].split(f"{store.table}/", 1)[1] for r in rows(store.df().select(F.input_file_name()).distinct())}
    store.vacuum()
    assert files() == used < before and sorted(rows(store.df())) == kept
    forget(spark, store)
    assert sorted(rows(reopened(spark, store).df())) == kept


def test_a_day_prunes(store, sample, capsys):
    store.insert(sample)
    store.df().where("event_date = date'2031-03-05' and line_number > 3").select("app").explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(event_date" in plan and "GreaterThan(line_number,3)" in plan


def test_negative_ids(spark, store):
    store.insert(spark.createDataFrame([(-1, "m")], "_rowid long, message string"), mode="overwrite", ids=False)
    assert store.get_by_id("-1").count() == 1 and store.get_by_id("-01").count() == 0 and store.get_by_id("9" * 5000).count() == 0


def test_broken_files_fail_or_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,m\n1,x\n2z,y\n")
    (tmp_path / "a.jsonl").write_text('{"n": 1, "m": "x"}\n{"n": \n')
    for name in ("a.csv", "a.jsonl"):
        with pytest.raises(Exception):
            read_table_file(spark, str(tmp_path / name), _schema()).collect()
        found = read_table_file(spark, str(tmp_path / name), _schema(), on_bad="quarantine").cache()
        assert tuple(bad_records(found).first()) == (2, 1), name


def _schema():
    return T.StructType([T.StructField("n", T.LongType()), T.StructField("m", T.StringType())])


def test_json_layout_is_told_file_by_file(spark, tmp_path):
    folder = tmp_path / "all.json"
    folder.mkdir()
    (folder / "a.json").write_text('{"n": 1}\n{"n": 2}\n')
    (folder / "b c.json").write_text('[\n{"n": 3},\n{"n": 4}\n]')
    (folder / "c.json").write_text('{\n"n": 5\n}')
    assert sorted(r["n"] for r in read_table_file(spark, str(folder)).collect()) == [1, 2, 3, 4, 5]
    (folder / "d.json").write_text('{\n"n": 6\n}\n{\n"n": 7\n}')
    with pytest.raises(ValueError, match="neither one JSON value nor"):
        read_table_file(spark, str(folder))


def test_a_day_can_lose_every_row_and_the_table_too(store, sample):
    store.insert(sample)
    store.delete_filter("line_number = 105")
    assert sorted(rows(store.df(), "line_number")) == [(10,), (42,)]
    store.delete_filter("true")
    assert count(store) == 0
    store.insert(sample, mode="append")
    assert count(store) == 3


def test_table_without_a_timestamp(spark, store):
    store.insert(spark.range(10).toDF("n"))
    store.delete_filter("n % 2 = 0")
    store.delete_record("1")
    assert sorted(rows(store.df())) == [(3, 3), (5, 5), (7, 7), (9, 9)]


def test_table_outlives_the_catalog(spark, tmp_path, sample):
    name = "logs_" + uuid.uuid4().hex
    LogStore(spark, str(tmp_path / "s"), name).insert(sample)
    again = LogStore(spark, str(tmp_path / "s"), name)
    forget(spark, again)
    again = LogStore(spark, str(tmp_path / "s"), name)
    assert again.exists() and count(again) == 3
    again.delete_record("0")
    assert count(again) == 2


def test_a_delete_leaves_other_days_alone(store, sample):
    store.insert(sample)
    before = {r["event_date"]: r["f"] for r in store.df().select("event_date", F.input_file_name().alias("f")).collect()}
    store.delete_record("0")
    after = {r["event_date"]: r["f"] for r in store.df().select("event_date", F.input_file_name().alias("f")).collect()}
    same = [d for d in before if before[d] == after[d]]
    assert [str(d) for d in same] == ["2031-03-05"]


def test_ingest_text_log(store, tmp_path):
    log = tmp_path / "pipe[1].log"
    log.write_text("orphan\n" + "".join(
        f"2026-08-{1 + i % 3:02d} 10:00:00 [INFO] app (f.py:{i}): m{i}\n  more\n" for i in range(50)))
    assert store.ingest_log_file(log) == 50
    # The number parsed, though nothing is stored this time.
    assert store.ingest_log_file(str(log)) == 50
    assert sorted(rows(store.df(), "_rowid", "line_number")) == [(i, i) for i in range(50)]
    assert store.ingest_log_file(log, mode="append") == 50
    assert sorted(r[0] for r in rows(store.df(), "_rowid")) == list(range(100))


def test_rows_are_numbered_in_ranges(spark, monkeypatch):
    monkeypatch.setattr("logquarry.sources.store._RANGE_BITS", 1)
    df = spark.range(0, 100, 1, 9).where("id % 3 <> 0 and (id < 30 or id > 60)")
    numbered = with_row_ids(df, 5)
    assert [i for _, i in sorted(rows(numbered, "_rowid", "id"))] == [r["id"] for r in df.collect()]
    assert sorted(r["_rowid"] for r in numbered.collect()) == list(range(5, 5 + df.count()))
    assert "Exchange SinglePartition" not in numbered._jdf.queryExecution().executedPlan().toString()


def test_row_ids_are_contiguous_in_row_order(spark):
    df = spark.range(0, 1000, 1, 7)
    assert rows(with_row_ids(df, 5).orderBy("id"), "_rowid", "id") == [(i + 5, i) for i in range(1000)]
    skewed = df.where("id < 3 or id > 990")
    assert [r[0] for r in rows(with_row_ids(skewed).orderBy("id"), "_rowid")] == list(range(12))


def test_formats(spark, tmp_path, sample):
    folder = tmp_path / "o'brien x"
    folder.mkdir()
    pdf = sample.toPandas()
    pdf.loc[0, "message"] = 'a "quoted", text\nover lines'
    records = json.loads(pdf.to_json(orient="records"))
    pdf.to_csv(folder / "a.CSV", index=False)
    pdf.iloc[1:].to_csv(folder / "plain.csv", index=False)
    pdf.to_parquet(folder / "a.parquet")
    (folder / "array.json").write_text("\n\n" + json.dumps(records, indent=1))
    (folder / "one_line_array.json").write_text(json.dumps(records))
    (folder / "lines.json").write_text("\n".join(json.dumps(r) for r in records))
    (folder / "lines.jsonl").write_text("\n".join(json.dumps(r) for r in records))
    (folder / "object.json").write_text(json.dumps(records[0], indent=2))
    for name, n in (("a.CSV", 3), ("plain.csv", 2), ("a.parquet", 3), ("array.json", 3), ("one_line_array.json", 3),
                    ("lines.json", 3), ("lines.jsonl", 3), ("object.json", 1)):
        found = read_table_file(spark, str(folder / name), multi_line=name == "a.CSV")
        assert found.count() == n, name
        assert dict(found.dtypes)["line_number"] == "bigint", name
        assert dict(found.dtypes)["timestamp"] == ("string" if name == "a.parquet" else "timestamp_ntz"), name
        if n != 2:
            first = found.where("line_number = 10").first()
            assert first["message"] == 'a "quoted", text\nover lines', name
            assert str(first["timestamp"])[:19] == "2031-03-04 10:00:00", name

    odd = folder / "a[1]{b}"
    odd.mkdir()
    (odd / "lines.jsonl").write_text(json.dumps(records[1]))
    (odd / "array.json").write_text(json.dumps(records, indent=1))
    assert read_table_file(spark, str(odd / "lines.jsonl")).count() == 1
    with pytest.raises(ValueError, match="pass a schema"):
        read_table_file(spark, str(odd / "array.json"))
    assert read_table_file(spark, str(odd / "array.json"), sample.schema).count() == 3


def test_validation(spark):
    df = spark.createDataFrame(
        SAMPLE + [("2026-13-01 00:00:00", "WARN", None, "f", 1, "m"), (None, None, "a", "f", None, None)], COLUMNS)
    checked = V.validate_logs(df)
    assert V.clean(checked).count() == 3 and V.clean(checked).columns == df.columns
    found = sorted(r["errors"] for r in V.quarantine(checked).collect())
    assert found == [
        ["bad_timestamp", "unknown_level", "missing_app"],
        ["missing_timestamp", "missing_level", "missing_line_number", "missing_message"],
    ]
    counts = {(r["rule"], r["app"]): r["n"] for r in V.violation_counts(checked).collect()}
    assert counts[("unknown_level", None)] == 1 and counts[("missing_level", "a")] == 1
    assert V.validate_logs(df.withColumn("line_number", F.lit("x1"))).where(
        F.array_contains("errors", "bad_line_number")).count() == 5


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
