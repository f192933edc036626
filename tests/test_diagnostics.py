import random

import pytest
from helpers import rows, value_of
from pyspark.sql import functions as F

from logquarry.functions import patterns as P
from logquarry.functions import traces as X
from logquarry.functions.sampling import sample_text
from logquarry.operators import diagnostics as D
from logquarry.operators import sampling as C
from logquarry.operators.ranking import top_k_per_group

TRACE = 'Traceback (most recent call last):\n  File "jobs/load.py", line 31\nOSError: full'


def test_two_traces_in_one_text(spark):
    text = f"start\n{TRACE}\n\n\nbetween\n{TRACE.replace('full', 'again')}\n\nrest"
    assert value_of(spark, X.tracebacks, text) == [TRACE, TRACE.replace('full', 'again')]
    assert value_of(spark, X.failure_text, text) == P.TRACES_TITLE + TRACE + "\n" + TRACE.replace('full', 'again')


def test_trace_runs_to_the_end_of_the_text(spark):
    assert value_of(spark, X.tracebacks, TRACE + "\n") == [TRACE + "\n"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("10:00 INFO a\n10:01 ERROR refused\n10:02 CRITICAL queue FAILED", "10:01 ERROR refused\n10:02 CRITICAL queue FAILED"),
        ("fine\nan unexceptional day\nfails", "an unexceptional day"),
        ("Traceback follows", "Traceback follows"),
    ],
)
def test_failure_lines(spark, text, expected):
    assert value_of(spark, X.failure_text, text) == P.LINES_TITLE + expected


@pytest.mark.parametrize("text", ["", "all is well\nfail", None])
def test_no_failure(spark, text):
    assert value_of(spark, X.failure_text, text) == (None if text is None else P.NO_FAILURE)
    assert value_of(spark, X.failure_lines, text) in ([], None)


def test_exception_parts(spark):
    head = 'Traceback (most recent call last):\n  File "a b.py", line 7, in <module>\n    go()\n  File "c.py", line 9, in go\n'
    assert [tuple(f) for f in value_of(spark, X.frames, head + "app.Oops: x: y\n")] == [("a b.py", 7, "<module>"), ("c.py", 9, "go")]
    for closing, expected in (
        ("app.Oops: x: y\n", ("app.Oops", "x: y")),
        ("    step()\n    ^^^^\nOops: one\ndetail: two\n\n", ("Oops", "one\ndetail: two")),
        ("KeyboardInterrupt", ("KeyboardInterrupt", "")),
        ("Oops:\n  indented", ("Oops", "\n  indented")),
        ("  nothing more", (None, None)),
    ):
        assert tuple(value_of(spark, X.exception, head + closing)) == expected, closing
    assert tuple(value_of(spark, X.exception, "Traceback (most recent call last):\nOops: bare")) == ("Oops", "bare")


def make_lines(n, flagged, seed=0):
    """Lines of which some have a context word, and which these are."""
    rng = random.Random(seed)
    marked = sorted(rng.sample(range(n), min(flagged, n)))
    words = {i: rng.choice(["ERROR", "WARN", "FAILED"]) for i in marked}
    return [f"line{i} {words.get(i, 'error')}" for i in range(n)], marked


def check_sample(lines, marked, kept, max_lines):
    """`kept`: (section, line).  Properties that fix the sample."""
    n = len(lines)
    part = {s: [x for t, x in kept if t == s] for s in ("all", "head", "middle", "tail")}
    if n <= max_lines:
        assert part["all"] == lines and len(kept) == n
        return
    tail_from = max(n - 20, min(15, n))
    assert part["head"] == lines[:15] and part["tail"] == lines[tail_from:] and not part["all"]
    between = [i for i in marked if 15 <= i < tail_from] or list(range(15, tail_from))
    places = [lines.index(x) for x in part["middle"]]
    assert places == sorted(places) and len(places) == min(15, len(between))
    assert set(places) <= set(between) and not any(i < max(places) and i not in places for i in between)


@pytest.mark.parametrize("max_lines", [0, 5, 50])
def test_sampling_one_text(spark, max_lines):
    sizes = [1, 5, 14, 15, 16, 34, 35, 36, 49, 50, 51, 65, 120]
    cases = [make_lines(n, flagged) for n in sizes for flagged in (0, 1, 40)]
    df = spark.createDataFrame([(i, "\n \t" + "\n".join(x) + " \n\n") for i, (x, _) in enumerate(cases)], "i int, t string")
    found = dict(rows(df.select("i", sample_text(F.col("t"), max_lines))))
    for i, (lines, marked) in enumerate(cases):
        if len(lines) <= max_lines:
            assert found[i] == "\n \t" + "\n".join(lines) + " \n\n"
            continue
        head, rest = found[i].split("\n\n... [TRUNCATED ")
        count, rest = rest.split(" LINES] ...\n\n", 1)
        middle, tail = rest.split("\n\n... [RECENT CRASH CONTEXT] ...\n")
        kept = [(s, x) for s, t in (("head", head), ("middle", middle), ("tail", tail)) for x in t.split("\n") if x]
        assert int(count) == len(lines) - len(kept)
        check_sample(lines, marked, kept, max_lines)


def test_sampling_a_text_without_lines(spark):
    df = spark.createDataFrame([("",), ("\n",), ("only line",)], "t string")
    assert [r[0] for r in rows(df.select(sample_text(F.col("t"))))] == ["", "\n", "only line"]


@pytest.mark.parametrize("max_lines", [5, 50, 70])
def test_sampling_groups_of_rows(spark, max_lines):
    groups = {f"g{i}" if i else None: make_lines(n, f, i) for i, (n, f) in enumerate(
        [(80, 2), (1, 0), (20, 3), (50, 9), (51, 0), (51, 51), (70, 2), (90, 60), (400, 1), (900, 300), (3000, 0)])}
    data = [(g, i, line) for g, (lines, _) in groups.items() for i, line in enumerate(lines)]
    random.Random(3).shuffle(data)
    df = spark.createDataFrame(data, "g string, i long, line string").repartition(7)
    sample = C.sample_context(df, ["g"], ["i"], max_lines=max_lines)
    found = {}
    order = {"all": 0, "head": 0, "middle": 1, "tail": 2}
    for g, section, pos, size, _, line in sorted(rows(sample), key=lambda r: (str(r[0]), order[r[1]], r[2])):
        assert size == len(groups[g][0])
        found.setdefault(g, []).append((section, line))
    assert set(found) == set(groups)
    for g, (lines, marked) in groups.items():
        check_sample(lines, marked, found[g], max_lines)
    texts = {r["g"]: r["payload"] for r in C.context_payload(sample, ["g"]).collect()}
    long = [g for g, (lines, _) in groups.items() if len(lines) > max_lines]
    assert all(texts[g].startswith("\n".join(groups[g][0][:15]) + "\n\n... [TRUNCATED ") for g in long)
    assert set(texts) == set(groups) and None in long


def test_more_rows_than_spark_limits_are_refused(spark):
    with pytest.raises(ValueError, match="rows per group"):
        C.sample_context(spark.createDataFrame([("g", 1, "x")], "g string, i long, line string"), ["g"], ["i"], max_lines=1001)


def test_sampling_keeps_bounded_candidates(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("lang").alias("g"), F.col("doc_id").alias("i"), F.col("text").alias("line"))
    plan = C.sample_keys(df, ["g"], ["i"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    moved = [x for x in plan.splitlines() if "Sort [" in x or "Exchange" in x]
    assert moved and not any("line" in x or "text" in x for x in moved)
    looked_up = C.sample_context(df, ["g"], ["i"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in looked_up and "Sort" not in looked_up and looked_up.count("BroadcastHashJoin") == 1


def test_top_k_does_not_depend_on_layout(spark):
    df = spark.range(1000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("g"), ((F.col("id") * 37) % 1000).alias("v"))
    expected = None
    for parts in (1, 6, 13):
        for salts in (1, 4):
            got = sorted(rows(top_k_per_group(df.repartition(parts), ["g"], [F.desc("v")], 5, salts=salts)))
            expected = expected or got
            assert got == expected and len(got) == 15


def logs(spark, records):
    df = spark.createDataFrame(records, "_rowid long, t string, level string, app string, message string")
    return df.select(
        "_rowid", F.col("t").cast("timestamp_ntz").alias("timestamp"), "level", "app",
        F.lit("f.py").alias("source_file"), F.lit(1).cast("bigint").alias("line_number"), "message",
    )


def failures(spark):
    at = 'Traceback (most recent call last):\n  File "a.py", line 7, in run\n'
    return logs(
        spark,
        [
            (0, "2026-01-01 00:00:00", "ERROR", "a", at + "KeyError: k"),
            (1, "2026-01-01 00:00:01", "ERROR", "a", at + "KeyError: k"),
            (2, "2026-01-01 00:00:02", "FATAL", "a", at + "OSError: x@y.zz"),
            (3, "2026-01-01 00:00:02", "ERROR", "b", "lost 172.16.0.9"),
            (4, "2026-01-01 00:00:03", "INFO", "c", at + "KeyError: k"),
            (5, "2026-01-01 00:00:04", "ERROR", "d", "Traceback (most recent call last):\n  nothing known"),
        ],
    )


def test_exception_profile(spark):
    found = {r["signature"]: r for r in D.exception_profile(D.exceptions(failures(spark))).collect()}
    key = found["KeyError at a.py:7 in run"]
    assert (key["n"], key["apps"], str(key["first_seen"]), str(key["last_seen"])) == (
        3, 2, "2026-01-01 00:00:00", "2026-01-01 00:00:03")
    assert "unknown at unknown" in found
    top = rows(D.top_exceptions(D.exceptions(failures(spark)), 1).where("app = 'a'"))
    assert top == [("a", 1, "KeyError at a.py:7 in run", 2)]


def test_recent_failures(spark):
    found = rows(D.recent_failures(failures(spark), 2).orderBy("app", "rank"), "app", "rank", "_rowid")
    assert found == [("a", 1, 2), ("a", 2, 1), ("b", 1, 3), ("d", 1, 5)]


def test_diagnosis(spark):
    found = {r["app"]: r["analysis"] for r in D.diagnose(failures(spark)).collect()}
    assert set(found) == {"a", "b", "d"}
    assert found["a"].split("\n") == [
        "- **Primary Issue**: 3 failed records in a",
        "- **Root Cause**: KeyError: k (2 traces)",
        "- **Affected Components/Files**: a.py:7 in run",
    ]
    assert P.NO_FAILURE in found["b"] and "none identified" in found["b"]


def test_diagnosis_without_traces_or_app_and_with_many_places(spark):
    at = 'Traceback (most recent call last):\n  File "f{}.py", line 1, in run\nOSError: full\ndetail: y'
    records = [(i, "2031-01-01 00:00:00", "ERROR", None, at.format(i)) for i in range(7)]
    records += [(10, "2031-01-01 00:00:00", "ERROR", "b", "it\n disk FAILED \nagain"), (11, "2031-01-01 00:00:01", "FATAL", "b", "x\n disk FAILED ")]
    found = {r["app"]: r for r in D.diagnose_with_evidence(logs(spark, records)).collect()}
    assert found[None]["subject"] == "(none)" and found[None]["failures"] == 7
    assert found[None]["analysis"].split("\n")[1:3] == ["- **Root Cause**: OSError: full", "detail: y (7 traces)"]
    assert found[None]["analysis"].endswith("f4.py:1 in run and 2 more")
    assert "- **Root Cause**: disk FAILED (2 lines)" in found["b"]["analysis"]
    assert "disk FAILED" in found["b"]["evidence"] and "2031-01-01 00:00:00 [ERROR]  (f.py:1): Traceback" in found[None]["evidence"]
    places = [(r["app"], r["frame"], r["traces"]) for r in D.affected_places(logs(spark, records)).collect()]
    assert len(places) == len(set(places)) and all(n > 0 for _, _, n in places)
    two = D.diagnose(logs(spark, records), ["app", "level"]).select("subject", "failures")
    assert sorted(rows(two)) == [("(none) on ERROR", 7), ("b on ERROR", 1), ("b on FATAL", 1)]
