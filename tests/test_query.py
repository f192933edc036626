import pytest
from helpers import rows, value_of, values_of
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from logquarry.functions import guards, statements
from logquarry.functions import patterns as P
from logquarry.operators import classify as Q
from logquarry.operators import profile as G
from logquarry.operators import query as S
from logquarry.functions.routing import routes

ALLOWED = [
    "SELECT app FROM jobs", "  select app, max(n) from jobs group by app", "WITH few AS (SELECT 1) TABLE few",
    "SHOW FUNCTIONS", "DESCRIBE jobs", "EXPLAIN SELECT 1", "select reflection, json from t",
]
NOT_READ_ONLY = ["INSERT INTO jobs SELECT 1", "merge into jobs", "REFRESH TABLE jobs", "selects 1", "(SELECT 2)", "7", "`x`"]
UNSAFE = [
    "SELECT 1; SELECT 2", "SELECT 1 -- two", "SELECT 3;", "WITH x AS (SELECT 1) INSERT INTO jobs TABLE x", "SELECT 'please call'",
    "SELECT /* 4 */ 4", "EXPLAIN DROP VIEW x",
]
ENGINE = [
    "SELECT java_method('java.lang.Math', 'abs', -1)", "select REFLECT ('a', 'b')", "SELECT `try_reflect`('a', 'b')",
    "SELECT * FROM parquet.`/data/x`", "SELECT * FROM `csv` . `x`", "SELECT TRANSFORM(n) USING 'cat' AS (x) FROM jobs",
    "SELECT * FROM `org.example.Reader`.`x`", "WITH x AS (SELECT 1) SELECT * FROM x MAP a USING 'cat'", "SELECT * FROM x.`s3a://b/c`", "SELECT IDENTIFIER('java_' || 'method')('a', 'b')",
]
EMPTY = ["", "   ", "\n\t "]


def test_the_guard_and_the_audit_agree(spark):
    cases = [(q, v) for v, qs in (
        (guards.OK, ALLOWED), (guards.NOT_READ_ONLY, NOT_READ_ONLY), (guards.UNSAFE, UNSAFE), (guards.ENGINE, ENGINE), (guards.EMPTY, EMPTY)) for q in qs]
    df = spark.createDataFrame(cases, "query string, expected string")
    for query, expected, verdict, token in rows(S.audit_queries(df)):
        assert verdict == expected, query
        assert (token is not None) == (verdict in (guards.UNSAFE, guards.ENGINE))
        if verdict == guards.OK:
            guards.check_query(query)
        else:
            with pytest.raises(ValueError) as refused:
                guards.check_query(query)
            assert value_of(spark, guards.query_rejection, query) == str(refused.value)
    assert values_of(spark, guards.query_rejection, ALLOWED) == [None] * len(ALLOWED)


def test_no_statement_runs_methods(spark):
    for query in ENGINE:
        with pytest.raises(ValueError, match="reaches past the tables"):
            S.run_query(spark, query)


READING = [
    "SELECT id FROM {t} WHERE id = ?", "WITH x AS (SELECT 1 AS a) SELECT * FROM x WHERE a IN (SELECT id FROM {t})", "SHOW TABLES",
    "SELECT transform(array(1), x -> x + 1) FROM {t} JOIN {t} AS u USING (id)", "SELECT * FROM {t} LATERAL VIEW explode(array(1)) e AS x",
    "SELECT sum(id) OVER (ORDER BY id) FROM range(3) GROUP BY id HAVING id > 0 ORDER BY 1 LIMIT 2", "EXPLAIN SELECT 1", "DESCRIBE default.t",
    "SELECT * FROM {t} PIVOT (sum(id) FOR id IN (1, 2)) UNION ALL VALUES (1, 2)", "SHOW DATABASES", "SHOW COLUMNS IN t",
]
REACHING = [
    "SELECT 1 WHERE 1 IN (SELECT TRANSFORM(id) USING 'cat' FROM {t})", "SELECT * FROM text.x", "SELECT * FROM `a.b.C`.x", "DESCRIBE text.`x`",
    "SELECT system.builtin.reflect('a', 'b')", "SELECT * FROM {t} LIMIT (SELECT length(reflect('a', 'b')))", "SELECT * FROM python_worker_logs()",
    "SELECT 1 GROUP BY abs(java_method('a', 'b'))", "SELECT * FROM IDENTIFIER('t')", "SELECT sum(1) OVER (ORDER BY `reflect`('a', 'b'))",
    "EXPLAIN SELECT * FROM orc.x", "EXPLAIN INSERT INTO t SELECT 1", "WITH x AS (SELECT * FROM csv.y) SELECT * FROM x", "SET a = b",
    "SELECT * FROM {t} |> SELECT reflect('a', 'b')", "SELECT input_file_name() FROM {t}", "SHOW COLUMNS IN text.`x`",
]


def test_structure_of_statements(spark):
    for query in READING:
        statements.check_statement(spark, query, ["t"])
    for query in REACHING:
        with pytest.raises(ValueError, match="reaches past the tables"):
            statements.check_statement(spark, query, ["t"])
    with pytest.raises(ParseException):
        statements.check_statement(spark, "SELECT (")


def test_structure_of_conditions(spark):
    for text in ("id > 3", "id IN (SELECT id FROM t)", "exists(array(1), x -> x > 1)"):
        statements.check_condition(spark, text)
    for text in ("id IN (SELECT TRANSFORM(id) USING 'cat' FROM t)", "id IN (SELECT id FROM text.x)", "system.builtin.reflect('a', 'b') > 0"):
        with pytest.raises(ValueError, match="reaches past the tables"):
            statements.check_condition(spark, text)


def test_a_refused_statement_is_a_result(spark):
    found = rows(S.query_results(spark, [(0, "SELECT * FROM text.x"), (1, "SELECT ("), (2, "SELECT 1 AS a")]), "verdict")
    assert found == [(guards.ENGINE,), ("failed",), (guards.OK,)]


BAD_FILTERS = [
    "n = 1; select 2", "n = 1 -- all", "n = 1 /* or */ or n = 2", "note = 'will copy'", "", "  ", "n in (select 1) or exec",
    "java_method('java.lang.Math', 'abs', -1) > 0", "exists (select 1 from parquet.`/x`)", None,
]


def test_filters(spark):
    good = ["level = 'ERROR'", "a = 1 AND b IS NULL", "deleted = 1", "uploaded > 2"]
    for text in BAD_FILTERS[:-1]:
        with pytest.raises(ValueError):
            guards.check_filter(text)
    for text in good:
        guards.check_filter(text)
    safe = values_of(spark, guards.filter_is_safe, BAD_FILTERS + good)
    assert safe == [False] * len(BAD_FILTERS) + [True] * len(good)


@pytest.fixture
def logs(spark):
    return spark.createDataFrame(
        [(0, "INFO", 10, "night run"), (1, "ERROR", 42, "a@b.cc lost"), (2, "ERROR", 99, "c@d.ee lost")],
        "_rowid long, level string, line_number long, message string",
    )


def test_filters_see_raw_values_and_results_are_redacted(spark, logs):
    found = S.run_query(spark, "SELECT * FROM {logs} WHERE message LIKE 'a@b%' AND level = ?", ("ERROR",), logs=logs)
    assert rows(found) == [(1, "ERROR", 42, "[REDACTED_EMAIL] lost")]
    grouped = S.run_query(spark, "SELECT message, count(*) AS n FROM {logs} GROUP BY message", (), logs=logs)
    assert sorted(rows(grouped)) == [("[REDACTED_EMAIL] lost", 1), ("[REDACTED_EMAIL] lost", 1), ("night run", 1)]
    with pytest.raises(ValueError):
        S.run_query(spark, "DROP TABLE logs")


def test_result_as_text(spark, logs):
    text = S.query_text(spark, "SELECT message FROM {logs} ORDER BY line_number", logs=logs)
    assert text == "| message |\n| --- |\n| night run |\n| [REDACTED_EMAIL] lost |\n| [REDACTED_EMAIL] lost |"
    assert S.query_text(spark, "SELECT * FROM {logs} WHERE level = 'DEBUG'", logs=logs) == P.EMPTY_RESULT
    for bad in ("DROP TABLE logs", "SELECT * FROM no_such_table", "SELECT"):
        assert S.query_text(spark, bad).startswith(P.QUERY_ERROR)
    many = S.query_text(spark, "SELECT id FROM {t} ORDER BY id", t=spark.range(100)).split("\n")
    assert many[-1] == "95 more rows" and many[2:7] == [f"| {i} |" for i in range(5)]
    cells = S.query_text(spark, "SELECT concat('a|b', chr(10), 'c') AS x")
    assert cells.split("\n")[2] == "| a\\|b<br>c |"


def test_results_of_many_statements(spark, logs):
    found = S.query_results(spark, [(1, "SELECT level FROM {logs}"), (2, "DROP TABLE x"), (3, "SELECT nothing"), (4, " ")], logs=logs)
    assert [(r["query_id"], r["verdict"], r["row_count"]) for r in found.collect()] == [
        (1, guards.OK, 3), (2, guards.NOT_READ_ONLY, None), (3, "failed", None), (4, guards.EMPTY, None)
    ]


def test_statements_about_tables_pass(spark, logs):
    logs.createOrReplaceTempView("some_logs")
    assert "some_logs" in [r["tableName"] for r in S.run_query(spark, "SHOW TABLES").collect()]
    assert "message" in [r["col_name"] for r in S.run_query(spark, "DESCRIBE some_logs").collect()]
    assert S.run_query(spark, "EXPLAIN SELECT * FROM some_logs").count() == 1


def test_preview_per_group(spark, logs):
    lost = logs.unionByName(spark.createDataFrame([(3, None, 7, "x|y a@b.cc\nz")], logs.schema))
    found = {r["level"]: r for r in S.preview_per_group(lost, ["level"], ["message"], [F.desc("line_number")], 1).collect()}
    assert found["ERROR"]["preview"] == "| message |\n| --- |\n| [REDACTED_EMAIL] lost |\n\n1 more rows" and found["ERROR"]["row_count"] == 2
    assert found[None]["preview"] == "| message |\n| --- |\n| x\\|y [REDACTED_EMAIL]<br>z |" and found[None]["row_count"] == 1


def test_profile(spark, logs):
    wide = logs.unionByName(spark.createDataFrame([(3, None, None, None)], logs.schema))
    found = {r["column_name"]: r for r in G.profile(wide, ["level"]).collect()}
    assert [r["position"] for r in sorted(found.values(), key=lambda r: r["position"])] == [0, 1, 2, 3]
    line = found["line_number"]
    assert (line["column_type"], line["row_count"], line["null_count"], line["min_value"], line["max_value"]) == (
        "bigint", 4, 1, "10", "99")
    assert found["message"]["min_value"] == "[REDACTED_EMAIL] lost"
    assert (found["level"]["distinct_count"], found["level"]["distinct_exact"], line["distinct_exact"]) == (2, True, False)
    many = spark.range(20000).select((F.col("id") % 5000).alias("v"))
    assert abs(G.profile(many).first()["distinct_count"] - 5000) < 500


def test_describe_tables(spark, logs):
    found = {r["table_name"]: r for r in G.describe_tables(spark, ["logs", "missing"], {"logs": logs}, {"logs": ["_rowid"]}, 2).collect()}
    assert found["logs"]["columns"] == "_rowid bigint, level string, line_number bigint, message string"
    assert found["logs"]["sample"] == "0 | INFO | 10 | night run\n1 | ERROR | 42 | [REDACTED_EMAIL] lost"
    assert found["logs"]["problem"] is None and found["missing"]["problem"] == "missing is not among the tables"


QUESTIONS = [
    ("count them", ["sql"]), ("AVERAGE load by level", ["sql"]), ("WHY IS IT SLOW", ["diagnostic"]),
    ("list the nodes", ["sql"]), ("top  7 nodes", ["sql"]), ("top nodes", []), ("which service is it", ["sql"]),
    ("show logs of node 3", ["sql"]), ("what broke", ["diagnostic"]), ("breaking news", []), ("it fails and failover", []),
    ("whyever so", []), ("find the root  cause and total them", ["diagnostic", "sql"]), ("diagnosis please", ["diagnostic"]),
    ("group\n by node", ["sql"]), ("by app", ["sql"]), ("on account of it", []), ("good morning", []), ("", []), ("   ", []), (None, []),
]


def test_routes(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(QUESTIONS)], "question_id int, question string")
    assert [r["routes"] for r in Q.classify(df).orderBy("question_id").collect()] == [x for _, x in QUESTIONS]


def test_fan_out_and_mix(spark):
    df = Q.classify(spark.createDataFrame(
        [(1, "why a@b.cc, count"), (2, "hello"), (3, "count it")], "question_id long, question string"))
    assert sorted(rows(Q.fan_out(df), "question_id", "route")) == [(1, "diagnostic"), (1, "sql"), (3, "sql")]
    assert "[REDACTED_EMAIL]" in Q.fan_out(df).where("question_id = 1").first()["question"]
    assert sorted(rows(Q.route_mix(df, []))) == [("diagnostic+sql", 1), ("sql", 1), ("unsupported", 1)]
    assert value_of(spark, routes, None) == []
