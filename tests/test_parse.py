import gzip
import random
from datetime import datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F

from logquarry.functions import lines as L
from logquarry.operators.stitch import parse_lines, parse_texts
from logquarry.schema import LOG_COLUMNS
from logquarry.sources import text_logs
from logquarry.sources.text_logs import count_records, escape_glob, read_log_lines, read_logs

HEAD = "2031-05-06 07:08:09 [ERROR] night_job (load.py:31): copy stopped"
WHEN = datetime(2031, 5, 6, 7, 8, 9)


def parse(spark, text, **options):
    df = spark.createDataFrame([(text,)], "value string")
    return rows(parse_texts(df, "value", **options), *LOG_COLUMNS)


def test_continuation_lines_join_the_record(spark):
    more = '\nTraceback (most recent call last):\n  File "b.py", line 4, in copy\nOSError: full'
    assert parse(spark, HEAD + more) == [(WHEN, "ERROR", "night_job", "load.py", 31, "copy stopped" + more)]


def test_schema_of_an_empty_result(spark):
    lines = spark.createDataFrame([("no header here\n\n", 1), (None, 2), ("", 3)], "value string, i int")
    df = parse_lines(lines, seq="i")
    assert df.count() == 0
    assert parse_texts(lines, "value").schema.simpleString() == df.schema.simpleString()
    assert parse_texts(lines, "value").count() == 0
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [
        ("timestamp", "timestamp_ntz"), ("level", "string"), ("app", "string"),
        ("source_file", "string"), ("line_number", "bigint"), ("message", "string"),
    ]


def record(level="ERROR", app="night_job", file="load.py", message="copy stopped"):
    return (WHEN, level, app, file, 31, message)


def changed(old, new):
    return HEAD.replace(old, new)


# A second line, and either the record that it begins or None where it goes on with the first.
SECOND = [
    (HEAD, record()),
    (" " + HEAD, None),
    (changed(": copy stopped", ":"), None),
    (changed(": copy stopped", ": "), record(message="")),
    (changed(": copy stopped", ":  x"), record(message="x")),
    (changed("night_job", "night-job"), None),
    (changed("night_job", "\u00e9t\u00e9"), record(app="\u00e9t\u00e9")),
    (changed("load.py", "D:/load.py"), None),
    (changed("load.py", "my load.py"), record(file="my load.py")),
    (changed("ERROR", "error"), None),
    (changed("ERROR", "PANIC"), record(level="PANIC")),
    (changed(" [", "\u00a0["), record()),
    (changed(" [", "\x1f["), record()),
    (changed(" [", "["), None),
    (changed("07:08:09", "07:08"), None),
    (HEAD + "\x85next", record(message="copy stopped\nnext")),
    (HEAD + "\u2028next\x0bmore\x1cand", record(message="copy stopped\nnext\nmore\nand")),
    (HEAD + "\r\nnext\rlast\n\n \t\n", record(message="copy stopped\nnext\nlast")),
    ("\u3000\n" + HEAD + "\n\x1f\n\u2003x", record(message="copy stopped\n\u2003x")),
]


def test_what_begins_a_record(spark):
    texts = [changed("copy stopped", "first") + "\n" + line for line, _ in SECOND]
    df = spark.createDataFrame([(str(i), 0, t) for i, t in enumerate(texts)], "f string, i int, value string")
    found = rows(parse_lines(df, file="f", seq="i", keep_file=True))
    for i, (line, begun) in enumerate(SECOND):
        expected = [record(message="first"), begun] if begun else [record(message="first\n" + line)]
        assert sorted(r[1:] for r in found if r[0] == str(i)) == sorted(expected), line
    alone = parse_texts(df, "value", keep=("f",))
    assert sorted(rows(alone)) == sorted(found)
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_position_stay_apart(spark):
    """Rows without a position come first, and rows with the same one keep their lines together."""
    first, second = changed("copy stopped", "a"), changed("copy stopped", "b")
    df = spark.createDataFrame(
        [(first + "\na1\na2", 5), (second + "\nb1\nb2", 5), (changed("copy stopped", "c") + "\nc1", None)], "value string, i int"
    )
    assert sorted(r[5] for r in rows(parse_lines(df.repartition(3), seq="i"))) == ["a\na1\na2", "b\nb1\nb2", "c\nc1"]


def test_bad_values_fail_or_are_kept_apart(spark):
    lines = spark.createDataFrame([(changed("05-06", "13-45"), 0)], "value string, i int")
    with pytest.raises(Exception, match="bad timestamp in log header"):
        parse_lines(lines, seq="i").collect()
    assert rows(parse_lines(lines, seq="i", on_bad="quarantine"), "timestamp") == [(None,)]
    for bad in (changed("05-06", "13-45"), changed(":31)", ":" + "9" * 30 + ")")):
        with pytest.raises(Exception, match="bad (timestamp|line number) in log header"):
            parse(spark, bad)
        ((when, *_, number, message),) = parse(spark, bad, on_bad="quarantine")
        assert (when is None) != (number is None)
        assert message == "copy stopped"
    with pytest.raises(ValueError):
        parse(spark, HEAD, on_bad="ignore")


def noisy_log(seed, records=400):
    """A log, and the records it was made of."""
    rng, made = random.Random(seed), []
    out = ["left over", "", "more left over"]
    for i in range(records):
        level, day, second = rng.choice(["INFO", "ERROR", "WARN"]), rng.randint(1, 28), rng.randint(0, 59)
        out.append(f"2031-01-{day:02d} 10:00:{second:02d} [{level}] app{i % 3} (f{i}.py:{i}): m{i}")
        # Now and then a record longer than many input splits.
        more = [
            rng.choice(["  at line %d" % j, "", "2031-01-01 no header", "\t", "Caused: x"])
            for j in range(rng.choice([0, 0, 0, 1, 3, 200 if i % 97 == 5 else 2]))
        ]
        out += more
        message = "\n".join([f"m{i}", *(x for x in more if x not in ("", "\t"))])
        made.append((datetime(2031, 1, day, 10, 0, second), level, f"app{i % 3}", f"f{i}.py", i, message))
    return "\n".join(out) + "\n", made


@pytest.fixture(scope="module")
def log_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    made = {}
    for i in range(3):
        text, made[f"f{i}.log"] = noisy_log(i)
        (folder / f"f{i}.log").write_text(text, encoding="utf-8")
    (folder / "empty.log").write_text("")
    text, made["z.log.gz"] = noisy_log(9)
    with gzip.open(folder / "z.log.gz", "wt", encoding="utf-8") as out:
        out.write(text)
    return folder, made


@pytest.mark.parametrize("split_bytes, partitions", [(1 << 27, 1), (4000, 4), (300, 7)])
def test_files_parse_alike_however_they_are_split(spark, settings, log_dir, split_bytes, partitions):
    folder, made = log_dir
    settings(
        spark__sql__files__maxPartitionBytes=split_bytes, spark__sql__files__openCostInBytes=64,
        spark__sql__shuffle__partitions=partitions,
    )
    expected = [r for name in sorted(made) for r in made[name]]
    found = rows(read_logs(spark, str(folder), row_ids=True))
    assert sorted(r[0] for r in found) == list(range(len(expected)))
    assert [r[1:] for r in sorted(found)] == expected
    assert count_records(spark, str(folder)) == len(expected)


def test_long_logs_in_a_column_are_cut_into_blocks(spark):
    text, made = noisy_log(4)
    lines = list(enumerate(text.split("\n")))
    random.Random(1).shuffle(lines)
    df = spark.createDataFrame([("one", i, x) for i, x in lines], "f string, i long, value string").repartition(5)
    expected = sorted(made)
    for bits in (2, 5, 16):
        assert sorted(rows(parse_lines(df, file="f", seq="i", block_bits=bits))) == expected
    # Without a name the rows still form one log.
    assert sorted(rows(parse_lines(df.withColumn("f", F.lit(None).cast("string")), file="f", seq="i"))) == expected


def test_a_file_without_headers_has_no_records(spark, tmp_path):
    (tmp_path / "none.log").write_text("no header\n" * 5000)
    assert read_logs(spark, str(tmp_path / "none.log"), row_ids=True).count() == 0


def test_lines_are_shuffled_once(spark, log_dir):
    df = read_logs(spark, str(log_dir[0]))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan or plan.count("FileScan text") == 1


def test_missing_path_and_glob_characters(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_logs(spark, str(tmp_path / "none.log"))
    odd = tmp_path / "a[1]{b}.log"
    odd.write_text(HEAD + "\n")
    assert read_logs(spark, escape_glob(str(odd))).count() == 1


def test_line_splitting_matches_splitlines(spark):
    text = "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i\r\nj\rk\nl"
    df = spark.createDataFrame([(text,)], "t string").select(L.split_lines(F.col("t")).alias("x"))
    assert df.first()["x"] == text.splitlines()


@pytest.mark.parametrize("suffix", ["", ".gz"])
def test_a_split_is_put_in_order_in_blocks(spark, tmp_path, monkeypatch, suffix):
    monkeypatch.setattr(text_logs, "_BLOCK_BITS", 2, raising=False)
    text = "lead\n\n" + "".join(f"{HEAD} {i}\n" + f"more {i}\n" * (i % 11) for i in range(60))
    for name in ("a", "b"):
        with (gzip.open if suffix else open)(tmp_path / f"{name}.log{suffix}", "wt") as out:
            out.write(text)
    blocks = read_log_lines(spark, str(tmp_path)).groupBy("file", "block").count()
    assert blocks.agg(F.max("count")).first()[0] <= 4
    got = read_logs(spark, str(tmp_path), row_ids=True).orderBy("_rowid").collect()
    assert [r["_rowid"] for r in got] == list(range(120))
    assert [r["message"] for r in got] == [f"copy stopped {i}" + f"\nmore {i}" * (i % 11) for i in range(60)] * 2
