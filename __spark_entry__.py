"""Registered queries, and for each the same result in plain SQL."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions import patterns as P
from logquarry.functions import sampling as sampling_text
from logquarry.functions import traces as X
from logquarry.functions.guards import QUERY_RULES, filter_is_safe
from logquarry.functions.redaction import redaction_counts, scrub, scrub_text
from logquarry.operators import access
from logquarry.operators import classify as Q
from logquarry.operators import diagnostics as D
from logquarry.operators import profile as G
from logquarry.operators import query as S
from logquarry.operators import sampling as C
from logquarry.operators import temporal
from logquarry.operators import validate as V
from logquarry.operators.stitch import parse_lines, parse_texts
from logquarry.plans import event_logs as E
from logquarry.plans import incidents, metrics
from logquarry.schema import LOG_SCHEMA, ROW_ID
from logquarry.session import scratch_path
from logquarry.sources.ledger import reload_logs
from logquarry.sources.store import LogStore
from logquarry.sources.tables import read_table_file
from logquarry.sources.text_logs import read_logs
from logquarry.streaming import tail

SMOKE_DIR = "/root/testdata/sf0.001"
DAY = "2024-01-15"
APP = "app_3"
GONE = "level = 'DEBUG' AND line_number > 250 OR source_file = 'signup.py' AND app = 'app_7'"


# -- inputs --------------------------------------------------------------------


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    return E.logs_from_events(spark, _table(spark, sf, "events"))


def _lost(logs: DataFrame) -> DataFrame:
    """The log with records whose app is gone."""
    return logs.withColumn("app", F.when(F.col(ROW_ID) % 13 != 0, F.col("app")))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return E.questions_from_events(spark, _table(spark, sf, "events"))


def _statements(spark: SparkSession, sf: str) -> DataFrame:
    return E.statements_from_events(spark, _table(spark, sf, "events"))


def _log_files(spark: SparkSession, sf: str) -> str:
    """The log as text files whose names and lines are in event order."""
    path = scratch_path(spark, "log-text")
    logs = _logs(spark, sf)
    logs.repartitionByRange(ROW_ID).sortWithinPartitions(ROW_ID).select(C.render_line()).write.text(path)
    return path


def _store(spark: SparkSession, sf: str) -> LogStore:
    """A fresh store that holds the log; the event id serves as row id."""
    path = scratch_path(spark, "store")
    store = LogStore(spark, path, "logs_" + path.rsplit("-", 1)[1])
    store.insert(_logs(spark, sf), mode="overwrite", ids=False)
    return store


# -- queries -------------------------------------------------------------------


def error_rate_by_app(spark, sf):
    """Raw lines to records to a rate, end to end."""
    rows = E.text_rows(_logs(spark, sf))
    return metrics.error_rate_by_app(parse_lines(rows, file="app", seq="seq"))


def log_parse(spark, sf):
    return parse_lines(E.text_rows(_logs(spark, sf)), file="app", seq="seq")


def log_file_parse(spark, sf):
    return read_logs(spark, _log_files(spark, sf))


def log_file_row_ids(spark, sf):
    return read_logs(spark, _log_files(spark, sf), row_ids=True)


def log_lines_single(spark, sf):
    """Each row a log of its own, of one record."""
    rows = _logs(spark, sf).select(C.render_line().alias("value"))
    return parse_texts(rows, "value").groupBy("app", "level").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("message")).alias("chars")
    )


def format_round_trip(spark, sf):
    """The log written and read back in each format, row by row; some messages hold quotes, some are empty."""
    odd = F.when(F.col(ROW_ID) % 5 == 0, "").when(F.col(ROW_ID) % 5 == 1, F.concat(F.lit('"'), "message", F.lit('", said\nit')))
    logs = E.log_columns(_logs(spark, sf).withColumn("message", F.coalesce(odd, "message")))
    out = None
    for suffix in ("csv", "json", "jsonl", "parquet"):
        path = f"{scratch_path(spark, 'formats')}.{suffix}"
        writer = logs.write
        if suffix == "csv":
            writer.option("escape", '"').option("emptyValue", "").csv(path, header=True, quoteAll=True)
        elif suffix == "parquet":
            writer.parquet(path)
        else:
            writer.json(path)
        back = read_table_file(spark, path, LOG_SCHEMA, multi_line=True)
        back = back.withColumn("message", F.coalesce("message", F.lit(""))).withColumn("format", F.lit(suffix))
        out = back if out is None else out.unionByName(back)
    return out


def _fresh_store(spark) -> LogStore:
    path = scratch_path(spark, "store")
    return LogStore(spark, path, "logs_" + path.rsplit("-", 1)[1])


def store_append(spark, sf):
    """Two halves of the log, the second appended; ids go on from the first."""
    logs, store = _logs(spark, sf).orderBy(ROW_ID), _fresh_store(spark)
    for odd, mode in ((0, "overwrite"), (1, "append")):
        store.insert(E.log_columns(logs.where(F.col(ROW_ID) % 2 == odd)), mode=mode)
    return store.df().drop("event_date")


def store_overwrite(spark, sf):
    """A full store replaced by its errors, with new ids."""
    store = _store(spark, sf)
    store.insert(E.log_columns(_logs(spark, sf).where("level = 'ERROR'").orderBy(ROW_ID)), mode="overwrite")
    return store.df().drop("event_date")


def store_ingest(spark, sf):
    """Text files into the store; a second ingest changes nothing."""
    files = _log_files(spark, sf)
    path = scratch_path(spark, "store")
    store = LogStore(spark, path, "logs_" + path.rsplit("-", 1)[1])
    store.ingest_log_file(files)
    store.ingest_log_file(files)
    return store.df().groupBy("event_date", "level").agg(
        F.count(F.lit(1)).alias("n"), F.min(ROW_ID).alias("first_id"), F.max(ROW_ID).alias("last_id")
    )


def store_reload(spark, sf):
    """Text files taken in, and the folder reloaded twice: once as it is, once with a file more."""
    path, half = scratch_path(spark, "store"), F.col(ROW_ID) % 3 == 0
    folder, store = scratch_path(spark, "log-text"), LogStore(spark, path, "logs_" + path.rsplit("-", 1)[1])
    lines = _logs(spark, sf).sortWithinPartitions(ROW_ID)
    for part in (half, half, ~half):
        lines.where(part & (F.col(ROW_ID) >= 0)).coalesce(1).select(C.render_line()).write.mode("ignore" if part is half else "append").text(folder)
        reload_logs(store, folder)
    reload_logs(store, folder)
    return store.df().drop("event_date")


def get_by_id(spark, sf):
    return _store(spark, sf).get_by_id("42").drop("event_date")


def delete_record(spark, sf):
    store = _store(spark, sf)
    store.delete_record("42")
    store.delete_record("0042")
    return store.df().drop("event_date")


def delete_filter(spark, sf):
    store = _store(spark, sf)
    store.delete_filter(GONE)
    return store.df().drop("event_date")


def delete_whole_day(spark, sf):
    store = _store(spark, sf)
    store.delete_filter(f"event_date = DATE'{DAY}'")
    return store.df().groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))


def _seeded(spark, sf):
    """The log with broken records: an unknown level, a lost app, and a bad time or line as text."""
    eid = F.col(ROW_ID)
    return _logs(spark, sf).select(
        ROW_ID,
        F.when(eid % 97 == 0, "2024-13-45 00:00:00").otherwise(F.col("timestamp").cast("string")).alias("timestamp"),
        F.when(eid % 11 == 0, "CRITICAL").otherwise(F.col("level")).alias("level"),
        F.when(eid % 13 != 0, F.col("app")).alias("app"),
        "source_file",
        F.when(eid % 89 == 0, "x1").otherwise(F.col("line_number").cast("string")).alias("line_number"),
        "message",
    )


def validate_logs(spark, sf):
    return V.validate_logs(_seeded(spark, sf)).select(ROW_ID, F.array_join("errors", ",").alias("errors"))


def validation_counts(spark, sf):
    return V.violation_counts(V.validate_logs(_seeded(spark, sf)))


def param_query(spark, sf):
    return S.run_query(
        spark,
        "SELECT * FROM {logs} WHERE level = ? AND app = ?",
        ("ERROR", APP),
        logs=_logs(spark, sf),
    )


def filter_raw_then_scrub(spark, sf):
    return S.run_query(
        spark, "SELECT _rowid, message FROM {logs} WHERE message LIKE '%@example.com from 10.0.7.%'",
        logs=_logs(spark, sf),
    )


def group_raw_then_scrub(spark, sf):
    return S.run_query(
        spark, "SELECT message, count(*) AS n FROM {logs} GROUP BY message", logs=_logs(spark, sf)
    )


def query_audit(spark, sf):
    return S.audit_queries(_statements(spark, sf)).select("query_id", "verdict", "token")


def query_audit_counts(spark, sf):
    return S.audit_counts(S.audit_queries(_statements(spark, sf)))


def query_preview(spark, sf):
    return S.preview_per_group(
        _lost(_logs(spark, sf)), ["app"], [ROW_ID, "level", "message"], [F.desc("timestamp"), F.desc(ROW_ID)]
    )


def table_profile(spark, sf):
    return G.profile(_table(spark, sf, "orders")).drop("distinct_count", "distinct_exact")


def table_profile_distinct(spark, sf):
    found = G.profile(_lost(_logs(spark, sf)), exact=["level", "app", "source_file", "line_number"])
    return found.where("distinct_exact").select("column_name", "row_count", "null_count", "distinct_count")


def table_descriptions(spark, sf):
    tables = {"logs": E.log_columns(_lost(_logs(spark, sf))), "nation": _table(spark, sf, "nation").select("n_nationkey", "n_name")}
    return G.describe_tables(spark, ["logs", "nothing", "nation"], tables, {"logs": ["line_number", "message"]})


def query_results(spark, sf):
    """Statements of all kinds, each with its rows, its error or its refusal."""
    logs = _logs(spark, sf)
    logs.createOrReplaceTempView("query_results_logs")
    statements = [
        (0, f"SELECT level, count(*) AS n FROM {{logs}} WHERE app = '{APP}' GROUP BY level ORDER BY level"),
        (1, "SELECT message FROM {logs} ORDER BY _rowid DESC"),
        (2, "SELECT app FROM {logs} WHERE level = 'NONE'"),
        (3, "DROP TABLE logs"),
        (4, "SELECT java_method('java.lang.Math', 'abs', -1)"),
        (5, "SELECT level FROM {logs} WHERE CAST(app AS INT) = 1"),
        (6, "DESCRIBE query_results_logs"),
    ]
    found = S.query_results(spark, statements, logs=logs)
    failed = F.col("verdict") == "failed"
    return found.withColumn("text", F.when(failed, F.substring("text", 1, len(P.QUERY_ERROR))).otherwise(F.col("text")))


def filter_audit(spark, sf):
    """Delete conditions made from events, judged as a column."""
    conditions = spark.sql(E.CONDITIONS_SQL.replace("{src}", "{events}"), events=_table(spark, sf, "events"))
    return conditions.select("filter_id", filter_is_safe(F.col("condition")).alias("safe"))


def table_samples(spark, sf):
    return G.sample_rows(_logs(spark, sf), [ROW_ID])


def scrub_documents(spark, sf):
    return scrub(_table(spark, sf, "documents"))


def scrub_pages(spark, sf):
    return scrub(_table(spark, sf, "pages"))


def scrub_conversations(spark, sf):
    """Each turn with an address of its speaker behind it."""
    turns = _table(spark, sf, "conversations")
    address = F.concat(F.lit(" from "), "role", F.lit("."), F.col("conv_id").cast("string"), F.lit("@mail.example.org"))
    return scrub(turns.withColumn("text", F.concat("text", address)))


def scrub_target_columns(spark, sf):
    logs = _logs(spark, sf).withColumn("copy", F.col("message"))
    return scrub(logs, ["message"])


def scrub_tokens(spark, sf):
    """Each whole document with a web token before and a bearer key behind it, both made from its hash."""
    digest = F.md5("text")
    text = F.concat(
        F.lit("auth eyJ"), digest, F.lit("."), F.reverse(digest), F.lit("."), F.substring(digest, 5, 9), F.lit(" "), "text",
        F.lit(" Authorization: Bearer \""), digest, F.lit("\" for doc "), F.col("doc_id").cast("string"),
    )
    return _table(spark, sf, "documents").select("doc_id", scrub_text(text).alias("text"))


def scrub_nested(spark, sf):
    logs = _logs(spark, sf).select(
        ROW_ID, F.struct("app", F.split("message", "\n").alias("lines")).alias("record")
    )
    deep = scrub(logs, deep=True)
    return deep.select(ROW_ID, "record.app", F.array_join("record.lines", "\n").alias("message"))


def redaction_audit(spark, sf):
    """Replacements per kind and app, and how many records have any.  Some records hold a web token as a key."""
    token = F.concat("message", F.lit(" token=eyJ"), F.md5("message"), F.lit(".a.b"))
    text = F.when(F.col(ROW_ID) % 3 == 0, token).otherwise(F.col("message"))
    counted = _logs(spark, sf).select("app", redaction_counts(text).alias("c"))
    kinds = ("jwt", "api_key", "email", "ip")
    some = sum((F.col(f"c.{k}") for k in kinds[1:]), F.col(f"c.{kinds[0]}")) > 0
    return counted.groupBy("app").agg(*[F.sum(f"c.{k}").alias(k) for k in kinds], F.count_if(some).alias("records"))


def tracebacks(spark, sf):
    return scrub(D.extract_tracebacks(_logs(spark, sf), "message", [ROW_ID]))


def _payloads(spark, sf):
    """Two copies of a message with a blank line between, so that a text holds two traces."""
    return _logs(spark, sf).select(
        ROW_ID, F.concat("message", F.lit("\n\n"), "message", F.lit("\nlast line")).alias("payload")
    )


def payload_tracebacks(spark, sf):
    return scrub(D.extract_tracebacks(_payloads(spark, sf), "payload", [ROW_ID]))


def failure_lines(spark, sf):
    return scrub(D.extract_failure_lines(_payloads(spark, sf), "payload", [ROW_ID]))


def trace_kind(spark, sf):
    return D.failure_kinds(_logs(spark, sf), "message", ["app"])


def failure_text(spark, sf):
    text = _payloads(spark, sf).select(ROW_ID, X.failure_text(F.col("payload")).alias("extract"))
    return scrub(text)


def _troubled(docs: DataFrame) -> DataFrame:
    """Whole documents, of which some report a failure in their middle and some hold a traceback."""
    n = F.col("doc_id").cast("string")
    line = F.concat(F.lit("\njob "), n, F.lit(" FAILED after "), F.col("n_chars").cast("string"), F.lit(" characters\n"))
    trace = F.concat(F.lit("\nTraceback (most recent call last):\n  File \"doc.py\", line "), n, F.lit(", in load\nOSError: "), "source", F.lit("\n\n"))
    middle = F.when(F.col("doc_id") % 3 == 0, line).when(F.col("doc_id") % 3 == 1, trace).otherwise("\n")
    return docs.withColumn("text", F.concat("text", middle, "text"))


def document_failure_lines(spark, sf):
    """Failure extracts of whole documents."""
    docs = _troubled(_table(spark, sf, "documents"))
    return docs.select("doc_id", X.failure_kind(F.col("text")).alias("kind"), X.failure_text(F.col("text")).alias("extract"))


def exception_profile(spark, sf):
    return D.exception_profile(D.exceptions(_logs(spark, sf)))


def top_exceptions(spark, sf):
    return D.top_exceptions(D.exceptions(_logs(spark, sf)))


def recent_failures(spark, sf):
    return D.recent_failures(_logs(spark, sf))


def context_sample(spark, sf):
    logs = _lost(_logs(spark, sf)).withColumn("line", C.render_line())
    return scrub(C.sample_context(logs, ["app"], ["timestamp", ROW_ID]))


def context_payload(spark, sf):
    lines = C.log_lines(_logs(spark, sf), ["app", "source_file"])
    sample = C.sample_context(lines, ["app", "source_file"], ["timestamp", ROW_ID, "pos"])
    return C.context_payload(sample, ["app", "source_file"])


def sample_text(spark, sf):
    """Every whole document, a sentence a line, cut by the one-text form; some have telling lines in the middle."""
    docs = _table(spark, sf, "documents")
    lines = F.replace(F.col("text"), F.lit(". "), F.lit(".\n"))
    telling = F.when(F.col("doc_id") % 2 == 0, F.replace(lines, F.lit("re"), F.lit("WARN"))).otherwise(lines)
    return docs.select("doc_id", sampling_text.sample_text(telling).alias("sample"))


def route_questions(spark, sf):
    routed = Q.classify(_questions(spark, sf))
    return routed.select("question_id", F.array_join("routes", "+").alias("routes"))


def route_conversations(spark, sf):
    """Turns with a request before them, of which there are four kinds."""
    kind = (F.col("conv_id") + F.col("turn")) % 4
    asked = F.when(kind == 0, "Why this: ").when(kind == 1, "List the parts of ").when(kind == 2, "Count, and diagnose ").otherwise("")
    routed = Q.classify(_table(spark, sf, "conversations").withColumn("text", F.concat(asked, "text")), "text")
    return routed.select("conv_id", "turn", F.array_join("routes", "+").alias("routes"))


def route_mix(spark, sf):
    routed = Q.classify(_questions(spark, sf)).withColumn("day", F.to_date("asked_at"))
    return Q.route_mix(routed, ["day"])


def route_fanout(spark, sf):
    return Q.fan_out(Q.classify(_questions(spark, sf))).select("question_id", "question", "route")


def diagnosis(spark, sf):
    """With the telling lines of the failed records."""
    found = D.diagnose_with_evidence(_lost(_logs(spark, sf)))
    return found.select("subject", "failures", "analysis", "evidence")


def failure_places(spark, sf):
    return D.affected_places(_lost(_logs(spark, sf)))


def _rejects(spark, sf):
    return _statements(spark, sf).select(
        (F.col("query_id") - F.col("query_id") % 3).alias("question_id"), F.col("query_id").alias("pos"), "query"
    )


def incident_report(spark, sf):
    return incidents.incident_reports(_questions(spark, sf), _logs(spark, sf), _rejects(spark, sf))


# -- extensions ----------------------------------------------------------------


def telling_exceptions(spark, sf):
    return D.telling_exceptions(D.exceptions(_logs(spark, sf)))


def context_budget(spark, sf):
    logs = _logs(spark, sf).withColumn("line", C.render_line())
    kept = C.within_budget(C.sample_context(logs, ["app"], ["timestamp", ROW_ID]), ["app"], 1500)
    return kept.select("app", "section", "pos_in_section", ROW_ID, "used")


def before_failures(spark, sf):
    """The last record of the same app before each failed one."""
    logs = _lost(_logs(spark, sf))
    before = logs.select("app", "timestamp", ROW_ID, F.col(ROW_ID).alias("last_id"), F.col("level").alias("last_level"))
    failed = logs.where(F.col("level").isin(*D.FAILURE_LEVELS)).select(ROW_ID, "app", "timestamp", "level")
    return temporal.asof_join(failed, before, ["app"], "timestamp", ROW_ID, ["last_id", "last_level"], 6 * 3600)


def questions_in_alerts(spark, sf):
    """Questions about an app from six hours before to thirty hours after the start of a day of many errors."""
    rates = metrics.error_rate_by_app(_lost(_logs(spark, sf))).where("error_rate > 0.25")
    alerts = rates.select(
        "app", F.col("day").alias("alert_day"), F.expr("cast(day as timestamp_ntz) - interval 6 hours").alias("first"),
        F.expr("cast(day as timestamp_ntz) + interval 30 hours").alias("last"),
    )
    asked = _questions(spark, sf).select("question_id", "app", "asked_at")
    return temporal.overlap_join(asked, alerts, ["app"], ("asked_at", "asked_at"), ("first", "last"), ["alert_day"], 24 * 3600)


def recorded_query(spark, sf):
    out, journal = scratch_path(spark, "result"), scratch_path(spark, "journal")
    statement = "SELECT _rowid, app, message FROM {logs} WHERE level = ?"
    S.run_recorded(spark, statement, out, journal, "sql", ("ERROR",), logs=_logs(spark, sf))
    return spark.read.parquet(journal).select("query", "route", "row_count", "redacted")


def alert_reports(spark, sf):
    return incidents.alert_reports(_lost(_logs(spark, sf)), 0.25)


def visible_records(spark, sf):
    logs = _logs(spark, sf)
    grants = logs.select("app").distinct().select(
        F.when(F.col("app").isin("app_1", "app_2"), "support").otherwise("admin").alias("role"), "app"
    )
    hidden = grants.where("role = 'support'").select("role", F.lit("message").alias("column_name"))
    return access.visible_to(logs, "support", grants, hidden)


def tailed_logs(spark, sf):
    """The text files followed as a stream, a few files at a time."""
    out = scratch_path(spark, "tail")
    tail.tail_logs(
        spark, _log_files(spark, sf), out, scratch_path(spark, "checkpoint"), files_per_batch=2
    ).awaitTermination()
    return spark.read.parquet(out).drop("batch")


def streamed_error_rate(spark, sf):
    """Windows of the record stream that can no longer change."""
    source, out = scratch_path(spark, "tail"), scratch_path(spark, "rates")
    files = _log_files(spark, sf)
    tail.tail_logs(spark, files, source, scratch_path(spark, "checkpoint")).awaitTermination()
    rates = tail.windowed_error_rate(tail.record_stream(spark, source))
    (
        rates.writeStream.format("parquet")
        .option("checkpointLocation", scratch_path(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start(out)
        .awaitTermination()
    )
    return spark.read.parquet(out)


def streamed_and_late(spark, sf):
    """Records per app of a stream whose files come a few at a time: those in windows and the late ones."""
    source, out = scratch_path(spark, "tail"), scratch_path(spark, "windows")
    tail.tail_logs(spark, _log_files(spark, sf), source, scratch_path(spark, "checkpoint"), files_per_batch=2).awaitTermination()
    records = tail.record_stream(spark, source, files_per_batch=4)
    tail.count_and_keep_late(records, out, scratch_path(spark, "checkpoint")).awaitTermination()
    both = tail.window_totals(spark, out).select("app", "records", "errors").union(
        tail.late_rows(spark, out).select("app", F.lit(1), F.when(F.col("level") == "ERROR", 1).otherwise(0))
    )
    return both.groupBy("app").agg(F.sum("records").alias("records"), F.sum("errors").alias("errors"))


def _on_tables(statement: str, *names: str) -> Callable[[SparkSession, str], DataFrame]:
    """A guarded statement over driver tables, the same text in both engines."""

    def run(spark, sf):
        frames = {n: _table(spark, sf, n) for n in names}
        text = statement
        for n in names:
            text = text.replace(f"@{n}", "{" + n + "}")
        return S.run_query(spark, text, **frames)

    return run


# Statement, tables.  A caller's own read-only SQL passes straight through.
PASS_THROUGH = {
    "sql_filter_cast": (
        "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS qty, "
        "CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS band FROM @lineitem "
        "WHERE l_shipdate >= DATE '1997-01-01' AND l_returnflag IN ('A', 'R')",
        ["lineitem"],
    ),
    "sql_aggregate": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, "
        "round(avg(l_quantity), 4) AS avg_qty, max(l_shipdate) AS last_ship FROM @lineitem "
        "GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
        ["lineitem"],
    ),
    "sql_distinct_aggregate": (
        "SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 10) AS big "
        "FROM @events GROUP BY event_type",
        ["events"],
    ),
    "sql_rollup": (
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM @orders "
        "GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
        ["orders"],
    ),
    "sql_cube": (
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM @orders "
        "GROUP BY CUBE (o_orderstatus, o_orderpriority)",
        ["orders"],
    ),
    "sql_top_k": (
        "SELECT o_orderkey, o_totalprice FROM @orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
        ["orders"],
    ),
    "sql_cte_join": (
        "WITH big AS (SELECT o_custkey, count(*) AS orders FROM @orders GROUP BY o_custkey) "
        "SELECT n.n_name, count(*) AS customers, sum(CAST(big.orders AS BIGINT)) AS orders FROM big "
        "JOIN @customer c ON c.c_custkey = big.o_custkey JOIN @nation n ON n.n_nationkey = c.c_nationkey "
        "GROUP BY n.n_name",
        ["orders", "customer", "nation"],
    ),
    "sql_semi_anti": (
        "SELECT c_nationkey, count(*) AS idle FROM @customer c WHERE NOT EXISTS "
        "(SELECT 1 FROM @orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT') AND c.c_nationkey IN "
        "(SELECT n_nationkey FROM @nation WHERE n_regionkey > 0) GROUP BY c_nationkey",
        ["customer", "orders", "nation"],
    ),
    "sql_outer_join": (
        "SELECT d.doc_id, l.quality, l.toxic FROM @documents d LEFT JOIN @labels l ON l.doc_id = d.doc_id",
        ["documents", "labels"],
    ),
    "sql_window": (
        "SELECT event_type, day, n, sum(n) OVER (PARTITION BY event_type ORDER BY day "
        "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last_three, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS previous, "
        "rank() OVER (PARTITION BY event_type ORDER BY n DESC) AS place FROM "
        "(SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM @events GROUP BY event_type, CAST(ts AS DATE))",
        ["events"],
    ),
    "sql_set_operations": (
        "SELECT o_custkey AS k FROM @orders EXCEPT SELECT c_custkey AS k FROM @customer "
        "UNION ALL SELECT c_custkey AS k FROM @customer INTERSECT SELECT o_custkey AS k FROM @orders",
        ["orders", "customer"],
    ),
    "sql_strings_dates": (
        "SELECT event_id, upper(event_type) AS kind, concat(event_type, '-', CAST(user_id AS STRING)) AS tag, "
        "length(props) AS size, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h FROM @events "
        "WHERE event_type LIKE '%i%'",
        ["events"],
    ),
    "sql_math": (
        "SELECT event_id, abs(value) AS a, CAST(floor(value) AS BIGINT) AS f, event_id % 7 AS m, "
        "round(sqrt(abs(value)), 6) AS root, greatest(event_id, user_id) AS g, coalesce(nullif(user_id, 8), -1) AS c "
        "FROM @events",
        ["events"],
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every implemented job, over the driver's tables."""
    simple = {
        "errors_by_app": metrics.errors_by_app,
        "errors_on_day": lambda logs: metrics.errors_on_day(logs, DAY),
        "top5_apps": metrics.top_apps,
        "count_by_level": metrics.count_by_level,
        "app_warnings": lambda logs: metrics.app_warnings(logs, APP),
        "source_file_events": lambda logs: metrics.source_file_events(logs, "error.py"),
        "first_event": metrics.first_event,
        "most_least_by_app": lambda logs: metrics.most_least(logs, "app"),
        "most_least_by_level": lambda logs: metrics.most_least(logs, "level"),
    }
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        name: (lambda spark, sf, f=f: f(_logs(spark, sf))) for name, f in simple.items()
    }
    found["avg_value_by_app"] = lambda spark, sf: metrics.average_by_app(
        _table(spark, sf, "events").withColumn("app", F.concat(F.lit("app_"), (F.col("user_id") % 10).cast("string"))),
        "value",
    )
    found["totals"] = lambda spark, sf: metrics.totals(_table(spark, sf, "events"), "value")
    for f in (
        error_rate_by_app, log_parse, log_file_parse, log_file_row_ids, log_lines_single, format_round_trip,
        store_ingest, store_append, store_overwrite, store_reload, get_by_id, delete_record, delete_filter, delete_whole_day, validate_logs, validation_counts,
        param_query, filter_raw_then_scrub, group_raw_then_scrub, query_audit, query_audit_counts, query_preview,
        table_profile, table_profile_distinct, table_descriptions, query_results, filter_audit, table_samples, scrub_documents, scrub_pages, scrub_conversations,
        scrub_target_columns, scrub_tokens, scrub_nested, redaction_audit, tracebacks, payload_tracebacks,
        failure_lines, trace_kind, failure_text, document_failure_lines, exception_profile, top_exceptions,
        recent_failures, context_sample, context_payload, sample_text, route_questions, route_conversations,
        route_mix, route_fanout, diagnosis, failure_places, incident_report, telling_exceptions, context_budget, before_failures, questions_in_alerts, recorded_query,
        alert_reports, visible_records, tailed_logs, streamed_error_rate, streamed_and_late,
    ):
        found[f.__name__] = f
    for name, (statement, tables) in PASS_THROUGH.items():
        found[name] = _on_tables(statement, *tables)
    return found | _training_data()[0]


def _training_data():
    """The queries and SQL for training data, where that subpackage and its pipeline are installed."""
    found, sql = {}, {}
    if importlib.util.find_spec("logquarry.llm") and importlib.util.find_spec("logquarry.llm.queries"):
        module = importlib.import_module("logquarry.llm.queries")
        found, sql = module.queries(), module.oracle_sql()
        if importlib.util.find_spec("corpus_pipeline"):
            module = importlib.import_module("corpus_pipeline")
            found["pipeline"] = module.run
            if module.ORACLE_SQL:
                sql["pipeline"] = module.ORACLE_SQL
    return found, sql


def entry(spark: SparkSession) -> DataFrame:
    """Raw log lines to the error rate per app and day."""
    return error_rate_by_app(spark, SMOKE_DIR)


# -- the same in plain SQL -----------------------------------------------------


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _derived(text: str) -> str:
    return text.replace("{ts}", "date_trunc('second', ts)").replace("{src}", "events")


def _clean(e: str) -> str:
    """Redaction as nested replacements."""
    for body, mark in (
        (P.JWT, P.JWT_MARK),
        ("(?i)" + P.API_KEY, "\\1" + P.API_KEY_MARK),
        (P.EMAIL, P.EMAIL_MARK),
        (P.IPV4, P.IPV4_MARK),
    ):
        e = f"regexp_replace({e}, {_lit(body)}, {_lit(mark)}, 'g')"
    return e


def _has_words(e: str) -> str:
    return "(" + " OR ".join(f"contains(lower({e}), '{w}')" for w in P.FAILURE_WORDS) + ")"


def _context(e: str) -> str:
    return "(" + " OR ".join(f"contains({e}, '{w}')" for w in P.CONTEXT_WORDS) + ")"


_TRACES = _lit(P.TRACE_BODY + r"(?:\n\n|\z)")
_LOG = "timestamp, level, app, source_file, line_number, message"
_ROUTES = (
    "concat_ws('+', CASE WHEN regexp_matches({q}, " + _lit(P.whole_words(P.DIAGNOSTIC_PHRASES)) + ", 'i') THEN 'diagnostic' END, "
    "CASE WHEN regexp_matches({q}, " + _lit(P.whole_words(P.SQL_PHRASES)) + ", 'i') THEN 'sql' END)"
)
_LINE = (
    "concat(strftime(timestamp, '%Y-%m-%d %H:%M:%S'), ' [', level, '] ', app, ' (', source_file, ':', line_number, '): ', "
    "message)"
)
_VERDICT = (
    "CASE WHEN trim(query) = '' THEN 'empty' "
    "WHEN upper(regexp_extract(trim(query), '^[A-Za-z]+')) NOT IN "
    "('SELECT', 'WITH', 'SHOW', 'DESCRIBE', 'EXPLAIN') THEN 'not_read_only' "
    f"WHEN regexp_matches(query, {_lit(P.UNSAFE_QUERY)}, 'i') THEN 'unsafe' "
    f"WHEN regexp_matches(query, {_lit(P.ENGINE_ACCESS)}, 'i') THEN 'engine_access' ELSE 'ok' END"
)
_TOKEN = (
    f"CASE verdict WHEN 'unsafe' THEN upper(regexp_extract(query, {_lit('(?i)' + P.UNSAFE_QUERY)})) "
    f"WHEN 'engine_access' THEN upper(regexp_extract(query, {_lit('(?i)' + P.ENGINE_ACCESS)})) END"
)
_FRAME_LINE = _lit(r'^\s+File "[^"]*", line [0-9]+')
# Line by line: the last frame, and behind it the first line that may name a type.
_EXC = f"""
traces AS (SELECT * EXCLUDE (message), unnest(regexp_extract_all(message, {_TRACES}, 1)) AS trace FROM logs),
cut AS (SELECT *, string_split(trace, chr(10)) AS ls FROM traces),
framed AS (SELECT *, coalesce(list_max(list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], {_FRAME_LINE}))), 0) AS f FROM cut),
closed AS (SELECT *, list_min(list_filter(range(f + 1, len(ls) + 1), lambda i: regexp_matches(ls[i], '^[A-Za-z_][A-Za-z0-9_.]*(:.*)?$'))) AS x FROM framed),
exceptions AS (SELECT *, coalesce(split_part(ls[x], ':', 1), 'unknown') AS exc_type,
  coalesce(rtrim(concat(regexp_extract(ls[x], '^[^:]*: ?(.*)$', 1), CASE WHEN len(ls) > x THEN concat(chr(10), array_to_string(ls[x + 1:], chr(10))) END), chr(10)), '') AS exc_message,
  CASE WHEN f > 0 THEN concat(regexp_extract(ls[f], 'File "([^"]*)"', 1), ':', regexp_extract(ls[f], 'line ([0-9]+)', 1), ' in ',
    regexp_extract(ls[f], 'line [0-9]+, in ([^ ]+)', 1)) ELSE 'unknown' END AS frame,
  concat(exc_type, ' at ', frame) AS signature FROM closed)"""


def _diagnosis(*group: str) -> str:
    """CTEs that end in `diagnoses`, from `logs` and `exceptions`; null is a group like any other."""
    g = ", ".join(group)

    def same(x: str) -> str:
        return " AND ".join(f"t.{c} IS NOT DISTINCT FROM {x}.{c}" for c in group)

    label = "concat_ws(' on ', " + ", ".join(f"coalesce(CAST(t.{c} AS VARCHAR), '(none)')" for c in group) + ")"
    return f"""
failed AS (SELECT * FROM logs WHERE level IN ('ERROR', 'FATAL')),
thrown AS (SELECT * FROM exceptions WHERE level IN ('ERROR', 'FATAL')),
totals AS (SELECT {g}, count(*) AS failures FROM failed GROUP BY {g}),
causes AS (SELECT {g}, exc_type, exc_message, count(*) AS n,
  row_number() OVER (PARTITION BY {g} ORDER BY count(*) DESC, exc_type, exc_message) AS r FROM thrown GROUP BY {g}, exc_type, exc_message),
hints AS (SELECT {g}, line, count(*) AS n, row_number() OVER (PARTITION BY {g} ORDER BY count(*) DESC, line) AS r FROM (
  SELECT {g}, unnest(list_filter(string_split(message, chr(10)), lambda x: {_has_words('x')})) AS line FROM failed
  WHERE NOT contains(message, {_lit(P.TRACE_HEADING)})) GROUP BY {g}, line),
places AS (SELECT {g}, frame, row_number() OVER (PARTITION BY {g} ORDER BY count(*) DESC, frame) AS r FROM thrown GROUP BY {g}, frame),
spots AS (SELECT {g}, string_agg(frame, ', ' ORDER BY r) FILTER (r <= 5) AS places, count(*) AS n FROM places GROUP BY {g}),
diagnoses AS (SELECT {", ".join("t." + c for c in group)}, {label} AS subject, t.failures,
  concat('- **Primary Issue**: ', t.failures, ' failed records in ', {label}, chr(10), '- **Root Cause**: ',
    coalesce(c.exc_type || CASE WHEN c.exc_message <> '' THEN ': ' || c.exc_message ELSE '' END || ' (' || c.n || ' traces)',
      trim(h.line) || ' (' || h.n || ' lines)', {_lit(P.NO_FAILURE)}),
    chr(10), '- **Affected Components/Files**: ', coalesce(s.places, 'none identified'),
    CASE WHEN s.n > 5 THEN concat(' and ', s.n - 5, ' more') END) AS analysis
  FROM totals t LEFT JOIN causes c ON {same("c")} AND c.r = 1 LEFT JOIN hints h ON {same("h")} AND h.r = 1 LEFT JOIN spots s ON {same("s")})"""


def _sampled(group: str, order: str, units: str) -> str:
    """CTEs that leave the kept units of each group in `kept`."""
    return f"""
units AS ({units}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS i,
  count(*) OVER (PARTITION BY {group}) AS group_lines, {_context('line')} AS flagged FROM units),
placed AS (SELECT *, CASE WHEN group_lines <= 50 THEN 'all' WHEN i <= 15 THEN 'head'
  WHEN i > group_lines - least(20, group_lines - 15) THEN 'tail' ELSE 'middle' END AS section FROM numbered),
telling AS (SELECT *, bool_or(flagged) OVER (PARTITION BY {group}, section) AS any_flagged FROM placed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {group}, section ORDER BY i) AS pos_in_section FROM telling
  WHERE section <> 'middle' OR NOT any_flagged OR flagged),
kept AS (SELECT * FROM ranked WHERE section <> 'middle' OR pos_in_section <= 15)"""


def oracle_sql() -> dict[str, str]:
    """The results that plain SQL can give."""
    logs = "WITH logs AS (" + _derived(E.LOGS_SQL) + ")"
    lost = "WITH logs AS (SELECT * REPLACE (CASE WHEN _rowid % 13 <> 0 THEN app END AS app) FROM (" + _derived(E.LOGS_SQL) + "))"
    one_cell = "replace(replace(replace({x}, '\\', '\\\\'), '|', '\\|'), chr(10), '<br>')"
    questions = "WITH questions AS (" + _derived(E.QUESTIONS_SQL) + ")"
    statements = "WITH statements AS (" + _derived(E.STATEMENTS_SQL) + ")"
    logs_clean = f"timestamp, level, app, source_file, line_number, {_clean('message')} AS message"
    rate = (
        "SELECT app, CAST(timestamp AS DATE) AS day, count(*) AS records, count(*) FILTER (level = 'ERROR') AS errors, "
        "round(count(*) FILTER (level = 'ERROR') / count(*), 6) AS error_rate FROM logs GROUP BY ALL"
    )
    most_least = (
        "{logs}, c AS (SELECT {by} AS value, count(*) AS n FROM logs GROUP BY ALL) "
        "SELECT '{by}' AS dimension, value, 'most' AS place, n FROM c WHERE n = (SELECT max(n) FROM c) UNION ALL "
        "SELECT '{by}', value, 'least', n FROM c WHERE n = (SELECT min(n) FROM c)"
    )
    errors = ", ".join(
        [
            "CASE WHEN _rowid % 97 = 0 THEN 'bad_timestamp' END",
            "CASE WHEN _rowid % 11 = 0 OR level = 'NOTICE' THEN 'unknown_level' END",
            "CASE WHEN _rowid % 13 = 0 THEN 'missing_app' END",
            "CASE WHEN _rowid % 89 = 0 THEN 'bad_line_number' END",
        ]
    )
    payloads = logs + ", payloads AS (SELECT _rowid, concat(message, chr(10), chr(10), message, chr(10), 'last line') AS payload FROM logs)"
    by_format = " UNION ALL ".join(
        f"SELECT '{x}' AS format, timestamp, level, app, source_file, line_number, CASE _rowid % 5 WHEN 0 THEN '' "
        "WHEN 1 THEN concat('\"', message, '\", said', chr(10), 'it') ELSE message END AS message FROM logs"
        for x in ("csv", "json", "jsonl", "parquet")
    )
    rendered = "SELECT app, timestamp, _rowid, " + _LINE + " AS line FROM logs"
    split = (
        "SELECT app, source_file, timestamp, _rowid, unnest(string_split(" + _LINE + ", chr(10))) AS line, "
        "generate_subscripts(string_split(" + _LINE + ", chr(10)), 1) AS pos FROM logs"
    )
    payload_texts = "texts AS (SELECT {group}, max(group_lines) AS group_lines, count(*) AS kept_lines, " + ", ".join(
        f"coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (section = '{x}'), '') AS {x}_text" for x in ("all", "head", "middle", "tail")
    ) + " FROM kept GROUP BY {group})"
    payload_cut = (
        "CASE WHEN group_lines <= 50 THEN all_text ELSE concat(head_text, chr(10), chr(10), '... [TRUNCATED ', group_lines - kept_lines, "
        "' LINES] ...', chr(10), chr(10), middle_text, chr(10), chr(10), '... [RECENT CRASH CONTEXT] ...', chr(10), tail_text) END"
    )
    doc_lines = "string_split(trim(text, {b}), chr(10))".format(b=_lit(" \t\n\r\x0b\x0c"))
    middle = "ls[16:len(ls) - 20]"
    telling = f"list_filter({middle}, lambda x: {_context('x')})"
    kept = f"CASE WHEN len({telling}) > 0 THEN {telling}[1:15] ELSE {middle}[1:15] END"
    found = {
        "error_rate_by_app": f"{logs} {rate}",
        "log_parse": f"{logs} SELECT {_LOG} FROM logs",
        "log_file_parse": f"{logs} SELECT {_LOG} FROM logs",
        "log_file_row_ids": f"{logs} SELECT row_number() OVER (ORDER BY _rowid) - 1 AS _rowid, {_LOG} FROM logs",
        "log_lines_single": f"{logs} SELECT app, level, count(*) AS n, CAST(sum(length(message)) AS BIGINT) AS chars FROM logs GROUP BY ALL",
        "format_round_trip": f"{logs} {by_format}",
        "store_ingest": f"{logs}, r AS (SELECT *, row_number() OVER (ORDER BY _rowid) - 1 AS id FROM logs) "
        "SELECT CAST(timestamp AS DATE) AS event_date, level, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM r GROUP BY ALL",
        "store_append": f"{logs} SELECT row_number() OVER (ORDER BY _rowid % 2, _rowid) - 1 AS _rowid, {_LOG} FROM logs",
        "store_overwrite": f"{logs} SELECT row_number() OVER (ORDER BY _rowid) - 1 AS _rowid, {_LOG} FROM logs WHERE level = 'ERROR'",
        "store_reload": f"{logs} SELECT row_number() OVER (ORDER BY _rowid % 3 <> 0, _rowid) - 1 AS _rowid, {_LOG} FROM logs",
        "get_by_id": f"{logs} SELECT _rowid, {logs_clean} FROM logs WHERE CAST(_rowid AS VARCHAR) = '42'",
        "delete_record": f"{logs} SELECT _rowid, {_LOG} FROM logs WHERE CAST(_rowid AS VARCHAR) NOT IN ('42', '0042')",
        "delete_filter": f"{logs} SELECT _rowid, {_LOG} FROM logs WHERE NOT coalesce({GONE}, false)",
        "delete_whole_day": f"{logs} SELECT CAST(timestamp AS DATE) AS event_date, count(*) AS n FROM logs WHERE CAST(timestamp AS DATE) <> DATE '{DAY}' GROUP BY ALL",
        "validate_logs": f"{logs} SELECT _rowid, concat_ws(',', {errors}) AS errors FROM logs",
        "validation_counts": f"{logs}, v AS (SELECT CASE WHEN _rowid % 13 <> 0 THEN app END AS app, unnest([{errors}]) AS rule FROM logs) "
        "SELECT rule, app, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY ALL",
        "param_query": f"{logs} SELECT _rowid, {logs_clean} FROM logs WHERE level = 'ERROR' AND app = '{APP}'",
        "filter_raw_then_scrub": f"{logs} SELECT _rowid, {_clean('message')} AS message FROM logs WHERE message LIKE '%@example.com from 10.0.7.%'",
        "group_raw_then_scrub": f"{logs} SELECT {_clean('message')} AS message, n FROM (SELECT message, count(*) AS n FROM logs GROUP BY message)",
        "query_audit": f"{statements}, v AS (SELECT query_id, query, {_VERDICT} AS verdict FROM statements) "
        f"SELECT query_id, verdict, {_TOKEN} AS token FROM v",
        "query_audit_counts": f"{statements}, v AS (SELECT query, {_VERDICT} AS verdict FROM statements) "
        f"SELECT verdict, {_TOKEN} AS token, count(*) AS n FROM v GROUP BY ALL",
        "query_preview": f"{lost}, r AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY timestamp DESC, _rowid DESC) AS r, count(*) OVER (PARTITION BY app) AS row_count FROM logs) "
        "SELECT app, concat('| _rowid | level | message |', chr(10), '| --- | --- | --- |', chr(10), "
        f"string_agg(concat('| ', _rowid, ' | ', level, ' | ', {one_cell.format(x=_clean('message'))}, ' |'), chr(10) ORDER BY r), "
        "CASE WHEN max(row_count) > 5 THEN concat(chr(10), chr(10), max(row_count) - 5, ' more rows') END) AS preview, max(row_count) AS row_count "
        "FROM r WHERE r <= 5 GROUP BY app",
        "table_profile": " UNION ALL ".join(
            f"SELECT {i} AS position, '{c}' AS column_name, CASE typeof(any_value({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' "
            f"WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS column_type, count(*) AS row_count, count(*) - count({c}) AS null_count, "
            f"CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM orders"
            for i, c in enumerate(("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
        ),
        "table_profile_distinct": f"{lost} " + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count FROM logs"
            for c in ("level", "app", "source_file", "line_number")
        ),
        "table_descriptions": f"{lost}, few AS (SELECT * FROM logs ORDER BY line_number, message LIMIT 3), "
        "three AS (SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey, n_name LIMIT 3) "
        "SELECT 'logs' AS table_name, 'timestamp timestamp_ntz, level string, app string, source_file string, line_number bigint, message string' AS columns, "
        "(SELECT string_agg(" + _clean("concat_ws(' | ', CAST(timestamp AS VARCHAR), level, coalesce(app, 'NULL'), source_file, line_number, message)")
        + ", chr(10) ORDER BY line_number, message) FROM few) AS sample, NULL AS problem "
        "UNION ALL SELECT 'nation', 'n_nationkey ' || (SELECT CASE typeof(any_value(n_nationkey)) WHEN 'INTEGER' THEN 'int' ELSE 'bigint' END FROM nation) || ', n_name string', "
        "(SELECT string_agg(concat(n_nationkey, ' | ', n_name), chr(10) ORDER BY n_nationkey, n_name) FROM three), NULL "
        "UNION ALL SELECT 'nothing', NULL, NULL, 'nothing is not among the tables'",
        "query_results": f"{logs}, levels AS (SELECT level, count(*) AS n FROM logs WHERE app = '{APP}' GROUP BY level), "
        "numbered AS (SELECT *, row_number() OVER (ORDER BY level) AS r, count(*) OVER () AS all_rows FROM levels), "
        "newest AS (SELECT *, row_number() OVER (ORDER BY _rowid DESC) AS r, count(*) OVER () AS all_rows FROM logs) "
        "SELECT 0 AS query_id, 'ok' AS verdict, max(all_rows) AS row_count, concat('| level | n |', chr(10), '| --- | --- |', chr(10), "
        "string_agg(concat('| ', level, ' | ', n, ' |'), chr(10) ORDER BY r) FILTER (r <= 5), "
        "CASE WHEN max(all_rows) > 5 THEN concat(chr(10), chr(10), max(all_rows) - 5, ' more rows') END) AS text FROM numbered "
        "UNION ALL SELECT 1, 'ok', max(all_rows), concat('| message |', chr(10), '| --- |', chr(10), string_agg(concat('| ', "
        + one_cell.format(x=_clean("message"))
        + ", ' |'), chr(10) ORDER BY r) FILTER (r <= 5), chr(10), chr(10), max(all_rows) - 5, ' more rows') FROM newest "
        f"UNION ALL SELECT 2, 'ok', 0, {_lit(P.EMPTY_RESULT)} "
        f"UNION ALL SELECT 3, 'not_read_only', NULL, {_lit(P.QUERY_ERROR + 'refused, ' + QUERY_RULES[1].says + ': DROP TABLE logs')} "
        "UNION ALL SELECT 4, 'engine_access', NULL, "
        + _lit(P.QUERY_ERROR + "refused, " + QUERY_RULES[3].says + ": SELECT java_method('java.lang.Math', 'abs', -1)")
        + f" UNION ALL SELECT 5, 'failed', NULL, {_lit(P.QUERY_ERROR)} "
        "UNION ALL SELECT 6, 'ok', 7, concat('| col_name | data_type | comment |', chr(10), '| --- | --- | --- |', chr(10), "
        "array_to_string(['| _rowid | bigint | NULL |', '| timestamp | timestamp_ntz | NULL |', '| level | string | NULL |', '| app | string | NULL |', "
        "'| source_file | string | NULL |'], chr(10)), chr(10), chr(10), '2 more rows')",
        "filter_audit": f"WITH c AS ({E.CONDITIONS_SQL.replace('{src}', 'events')}) SELECT filter_id, trim(condition) <> '' "
        f"AND NOT regexp_matches(condition, {_lit(P.UNSAFE_FILTER)}, 'i') AND NOT regexp_matches(condition, {_lit(P.ENGINE_ACCESS)}, 'i') AS safe FROM c",
        "table_samples": f"{logs} SELECT _rowid, {logs_clean} FROM logs ORDER BY _rowid LIMIT 3",
        "scrub_documents": f"SELECT doc_id, {_clean('text')} AS text, lang, source, n_chars FROM documents",
        "scrub_pages": f"SELECT page_id, {_clean('url')} AS url, {_clean('html')} AS html FROM pages",
        "scrub_conversations": "SELECT conv_id, turn, role, "
        + _clean("concat(text, ' from ', role, '.', conv_id, '@mail.example.org')") + " AS text FROM conversations",
        "scrub_target_columns": f"{logs} SELECT _rowid, {logs_clean}, message AS copy FROM logs",
        "scrub_tokens": "SELECT doc_id, " + _clean(
            "concat('auth eyJ', md5(text), '.', reverse(md5(text)), '.', substr(md5(text), 5, 9), ' ', text, "
            "' Authorization: Bearer \"', md5(text), '\" for doc ', doc_id)"
        ) + " AS text FROM documents",
        "scrub_nested": f"{logs} SELECT _rowid, app, {_clean('message')} AS message FROM logs",
        "redaction_audit": f"{logs}, t0 AS (SELECT app, CASE WHEN _rowid % 3 = 0 THEN concat(message, ' token=eyJ', md5(message), '.a.b') ELSE message END AS x0 FROM logs), "
        + ", ".join(
            f"t{i + 1} AS (SELECT *, len(regexp_extract_all(x{i}, {_lit(p)})) AS {k}, regexp_replace(x{i}, {_lit(p)}, {_lit(m)}, 'g') AS x{i + 1} FROM t{i})"
            for i, (k, p, m) in enumerate((
                ("jwt", P.JWT, P.JWT_MARK), ("api_key", "(?i)" + P.API_KEY, "\\1" + P.API_KEY_MARK), ("email", P.EMAIL, P.EMAIL_MARK), ("ip", P.IPV4, P.IPV4_MARK)))
        )
        + " SELECT app, " + ", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}" for k in ("jwt", "api_key", "email", "ip"))
        + ", count(*) FILTER (jwt + api_key + email + ip > 0) AS records FROM t4 GROUP BY app",
        "tracebacks": f"{logs} SELECT _rowid, CAST(0 AS BIGINT) AS trace_no, {_clean('t')} AS trace FROM (SELECT _rowid, unnest(regexp_extract_all(message, {_TRACES}, 1)) AS t FROM logs)",
        "payload_tracebacks": f"{payloads}, t AS (SELECT _rowid, regexp_extract_all(payload, {_TRACES}, 1) AS ts FROM payloads) "
        f"SELECT _rowid, CAST(n - 1 AS BIGINT) AS trace_no, {_clean('tr')} AS trace FROM (SELECT _rowid, unnest(ts) AS tr, generate_subscripts(ts, 1) AS n FROM t)",
        "failure_lines": f"{payloads}, l AS (SELECT _rowid, list_filter(string_split(payload, chr(10)), lambda x: {_has_words('x')}) AS ls FROM payloads "
        f"WHERE NOT contains(payload, '{P.TRACE_HEADING}')) "
        f"SELECT _rowid, CAST(n - 1 AS BIGINT) AS line_no, {_clean('line')} AS line FROM (SELECT _rowid, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM l)",
        "trace_kind": f"{logs} SELECT app, CASE WHEN contains(message, '{P.TRACE_HEADING}') THEN 'traceback' WHEN {_has_words('message')} THEN 'lines' ELSE 'none' END AS kind, count(*) AS n FROM logs GROUP BY ALL",
        "failure_text": f"{payloads} SELECT _rowid, " + _clean(
            f"CASE WHEN contains(payload, '{P.TRACE_HEADING}') THEN concat({_lit(P.TRACES_TITLE)}, array_to_string(regexp_extract_all(payload, {_TRACES}, 1), chr(10))) "
            f"WHEN {_has_words('payload')} THEN concat({_lit(P.LINES_TITLE)}, array_to_string(list_filter(string_split(payload, chr(10)), lambda x: {_has_words('x')}), chr(10))) "
            f"ELSE {_lit(P.NO_FAILURE)} END"
        ) + " AS extract FROM payloads",
        "document_failure_lines": "WITH documents AS (SELECT doc_id, concat(text, CASE doc_id % 3 WHEN 0 THEN concat(chr(10), 'job ', doc_id, ' FAILED after ', n_chars, "
        "' characters', chr(10)) WHEN 1 THEN concat(chr(10), 'Traceback (most recent call last):', chr(10), '  File \"doc.py\", line ', doc_id, ', in load', chr(10), "
        "'OSError: ', source, chr(10), chr(10)) ELSE chr(10) END, text) AS text FROM documents) SELECT doc_id, "
        f"CASE WHEN contains(text, '{P.TRACE_HEADING}') THEN 'traceback' WHEN {_has_words('text')} THEN 'lines' ELSE 'none' END AS kind, "
        f"CASE WHEN contains(text, '{P.TRACE_HEADING}') THEN concat({_lit(P.TRACES_TITLE)}, array_to_string(regexp_extract_all(text, {_TRACES}, 1), chr(10))) "
        f"WHEN {_has_words('text')} THEN concat({_lit(P.LINES_TITLE)}, array_to_string(list_filter(string_split(text, chr(10)), lambda x: {_has_words('x')}), chr(10))) "
        f"ELSE {_lit(P.NO_FAILURE)} END AS extract FROM documents",
        "exception_profile": f"{logs}, {_EXC} SELECT signature, exc_type, frame, count(*) AS n, count(DISTINCT app) AS apps, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM exceptions GROUP BY ALL",
        "top_exceptions": f"{logs}, {_EXC}, c AS (SELECT app, signature, count(*) AS n, row_number() OVER (PARTITION BY app ORDER BY count(*) DESC, signature) AS rank FROM exceptions GROUP BY app, signature) SELECT app, rank, signature, n FROM c WHERE rank <= 3",
        "recent_failures": f"{logs}, r AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY timestamp DESC, _rowid DESC) AS rank FROM logs WHERE level IN ('ERROR', 'FATAL')) "
        f"SELECT app, rank, _rowid, timestamp, level, source_file, line_number, {_clean('message')} AS message FROM r WHERE rank <= 20",
        "context_sample": f"{lost}, {_sampled('app', 'timestamp, _rowid', rendered)} "
        f"SELECT app, section, pos_in_section, group_lines, timestamp, _rowid, {_clean('line')} AS line FROM kept",
        "context_payload": f"{logs}, {_sampled('app, source_file', 'timestamp, _rowid, pos', split)}, "
        + payload_texts.format(group="app, source_file") + " SELECT app, source_file, group_lines, kept_lines, " + _clean(payload_cut)
        + " AS payload FROM texts",
        "sample_text": "WITH documents AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(replace(text, '. ', '.' || chr(10)), 're', 'WARN') "
        f"ELSE replace(text, '. ', '.' || chr(10)) END AS text FROM documents), d AS (SELECT doc_id, text, {doc_lines} AS ls FROM documents), "
        "cut AS (SELECT doc_id, text, ls, least(15, len(ls)) AS h, least(20, len(ls) - least(15, len(ls))) AS t FROM d), "
        "parts AS (SELECT *, ls[1:h] AS head, ls[len(ls) - t + 1:len(ls)] AS tail, ls[h + 1:len(ls) - t] AS mid FROM cut), "
        f"tell AS (SELECT *, list_filter(mid, lambda x: {_context('x')}) AS hit FROM parts), "
        "kept AS (SELECT *, CASE WHEN len(hit) > 0 THEN hit[1:15] ELSE mid[1:15] END AS m FROM tell) "
        "SELECT doc_id, CASE WHEN len(ls) <= 50 THEN text ELSE concat(array_to_string(head, chr(10)), chr(10), chr(10), "
        "'... [TRUNCATED ', len(ls) - h - t - len(m), ' LINES] ...', chr(10), chr(10), array_to_string(m, chr(10)), "
        "chr(10), chr(10), '... [RECENT CRASH CONTEXT] ...', chr(10), array_to_string(tail, chr(10))) END AS sample FROM kept",
        "route_questions": f"{questions} SELECT question_id, {_ROUTES.format(q='question')} AS routes FROM questions",
        "route_conversations": "WITH c AS (SELECT conv_id, turn, concat(CASE (conv_id + turn) % 4 WHEN 0 THEN 'Why this: ' WHEN 1 THEN 'List the parts of ' "
        f"WHEN 2 THEN 'Count, and diagnose ' ELSE '' END, text) AS text FROM conversations) SELECT conv_id, turn, {_ROUTES.format(q='text')} AS routes FROM c",
        "route_mix": f"{questions} SELECT CAST(asked_at AS DATE) AS day, coalesce(nullif({_ROUTES.format(q='question')}, ''), 'unsupported') AS route_set, count(*) AS n FROM questions GROUP BY ALL",
        "route_fanout": f"{questions} SELECT question_id, {_clean('question')} AS question, unnest(string_split({_ROUTES.format(q='question')}, '+')) AS route FROM questions WHERE {_ROUTES.format(q='question')} <> ''",
        "diagnosis": f"{lost}, {_EXC}, {_diagnosis('app')}, "
        + _sampled("app", "timestamp, _rowid, pos", split.replace("FROM logs", "FROM failed").replace("app, source_file,", "app,")) + ", "
        + payload_texts.format(group="app") + " SELECT subject, failures, " + _clean("analysis") + " AS analysis, " + _clean(payload_cut) + " AS evidence "
        "FROM diagnoses d LEFT JOIN texts p ON p.app IS NOT DISTINCT FROM d.app",
        "before_failures": f"{lost}, placed AS (SELECT *, coalesce(app, '(none)') AS a, CAST(epoch(timestamp) AS BIGINT) * 1000000000 + _rowid AS k FROM logs) "
        "SELECT f._rowid, f.app, f.timestamp, f.level, b._rowid AS last_id, b.level AS last_level "
        "FROM (SELECT * FROM placed WHERE level IN ('ERROR', 'FATAL')) f ASOF LEFT JOIN placed b ON f.a = b.a AND f.k > b.k",
        "questions_in_alerts": f"{lost}, questions AS ({_derived(E.QUESTIONS_SQL)}), "
        "rates AS (SELECT app, CAST(timestamp AS DATE) AS day FROM logs GROUP BY ALL "
        "HAVING round(sum(CASE WHEN level = 'ERROR' THEN 1 ELSE 0 END) / count(*), 6) > 0.25) "
        "SELECT q.question_id, q.app, q.asked_at, r.day AS alert_day FROM questions q JOIN rates r ON q.app IS NOT DISTINCT FROM r.app "
        "AND q.asked_at BETWEEN r.day - INTERVAL 6 HOUR AND r.day + INTERVAL 30 HOUR",
        "failure_places": f"{lost}, {_EXC} SELECT app, {_clean('frame')} AS frame, count(*) AS traces FROM exceptions "
        "WHERE level IN ('ERROR', 'FATAL') GROUP BY ALL",
        "incident_report": f"{logs}, {_EXC}, {_diagnosis('app')}, questions AS ({_derived(E.QUESTIONS_SQL)}), statements AS ({_derived(E.STATEMENTS_SQL)}), "
        "counts AS (SELECT app, level, count(*) AS n, row_number() OVER (PARTITION BY app ORDER BY count(*) DESC, level) AS r FROM logs GROUP BY app, level), "
        "previews AS (SELECT app, '| level | records |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(concat('| ', level, ' | ', n, ' |'), chr(10) ORDER BY r) AS preview FROM counts GROUP BY app), "
        f"audited AS (SELECT query_id, query, {_VERDICT} AS verdict FROM statements), "
        "bullets AS (SELECT query_id - query_id % 3 AS question_id, string_agg(concat('- Error executing query: ', CASE verdict "
        + " ".join(
            f"WHEN '{r.verdict}' THEN " + _lit(f"refused, {r.says}" + ("" if r.verdict == "empty" else ": "))
            + ("" if r.verdict == "empty" else " || trim(query)")
            for r in QUERY_RULES
        )
        + " END), chr(10) ORDER BY query_id) AS warnings "
        "FROM audited WHERE verdict <> 'ok' GROUP BY ALL), "
        f"asked AS (SELECT q.*, {_ROUTES.format(q='question')} AS routes FROM questions q), "
        "parts AS (SELECT a.question_id, trim(a.question) AS title, CASE WHEN contains(a.routes, 'diagnostic') THEN d.analysis END AS analysis, "
        "CASE WHEN contains(a.routes, 'sql') THEN p.preview END AS result, b.warnings FROM asked a LEFT JOIN diagnoses d ON d.app = a.app "
        "LEFT JOIN previews p ON p.app = a.app LEFT JOIN bullets b ON b.question_id = a.question_id) "
        "SELECT question_id, " + _clean(
            "concat_ws(chr(10) || chr(10), CASE WHEN title <> '' THEN '# ' || title ELSE '# Question' END, "
            "'## Root Cause Analysis' || chr(10) || analysis, '## Query Results' || chr(10) || result, "
            "CASE WHEN analysis IS NULL AND result IS NULL THEN 'No results available for this question.' END, "
            "'## Warnings' || chr(10) || warnings)"
        ) + " AS report FROM parts",
        "telling_exceptions": f"{logs}, {_EXC}, r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY "
        "CASE level WHEN 'FATAL' THEN 0 WHEN 'ERROR' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'INFO' THEN 3 WHEN 'DEBUG' THEN 4 ELSE 5 END, "
        f"timestamp DESC, _rowid DESC) AS rank FROM exceptions) SELECT signature, rank, _rowid, timestamp, level, app, {_clean('trace')} AS trace FROM r WHERE rank <= 3",
        "context_budget": f"{logs}, {_sampled('app', 'timestamp, _rowid', rendered)}, "
        "u AS (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY app ORDER BY "
        "CASE section WHEN 'tail' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END, CASE section WHEN 'tail' THEN -pos_in_section ELSE pos_in_section END "
        "ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM kept) SELECT app, section, pos_in_section, _rowid, used FROM u WHERE used <= 1500",
        "recorded_query": f"{logs} SELECT 'SELECT _rowid, app, message FROM {{logs}} WHERE level = ?' AS query, 'sql' AS route, count(*) AS row_count, "
        f"count(*) FILTER (message <> {_clean('message')}) AS redacted FROM logs WHERE level = 'ERROR'",
        "alert_reports": f"{lost.replace('WITH logs', 'WITH base')}, rates AS (SELECT app, CAST(timestamp AS DATE) AS day FROM base GROUP BY ALL "
        "HAVING round(count(*) FILTER (level = 'ERROR') / count(*), 6) > 0.25), "
        "logs AS (SELECT b.*, r.day FROM base b JOIN rates r ON r.app IS NOT DISTINCT FROM b.app AND r.day = CAST(b.timestamp AS DATE)), "
        f"{_EXC}, {_diagnosis('app', 'day')} SELECT subject, {_clean('analysis')} AS analysis FROM diagnoses",
        "visible_records": f"{logs} SELECT _rowid, timestamp, level, app, source_file, line_number FROM logs WHERE app IN ('app_1', 'app_2')",
        "tailed_logs": f"{logs} SELECT {_LOG} FROM logs",
        "streamed_error_rate": f"{logs} SELECT app, date_trunc('hour', timestamp) AS window_start, count(*) AS records, "
        "count(*) FILTER (level = 'ERROR') AS errors, round(count(*) FILTER (level = 'ERROR') / count(*), 6) AS error_rate FROM logs "
        "WHERE date_trunc('hour', timestamp) + INTERVAL 1 HOUR <= (SELECT max(timestamp) - INTERVAL 10 MINUTE FROM logs) GROUP BY ALL",
        "streamed_and_late": f"{logs} SELECT app, count(*) AS records, count(*) FILTER (level = 'ERROR') AS errors FROM logs GROUP BY app",
        "errors_by_app": f"{logs} SELECT app, count(*) AS errors FROM logs WHERE level = 'ERROR' GROUP BY app",
        "errors_on_day": f"{logs} SELECT count(*) AS errors FROM logs WHERE level = 'ERROR' AND CAST(timestamp AS DATE) = DATE '{DAY}'",
        "top5_apps": f"{logs} SELECT app, count(*) AS errors FROM logs WHERE level = 'ERROR' GROUP BY app ORDER BY errors DESC, app LIMIT 5",
        "count_by_level": f"{logs} SELECT level, count(*) AS n FROM logs GROUP BY level",
        "app_warnings": f"{logs} SELECT _rowid, {logs_clean} FROM logs WHERE app = '{APP}' AND level = 'WARNING'",
        "source_file_events": f"{logs} SELECT _rowid, {logs_clean} FROM logs WHERE source_file = 'error.py' ORDER BY timestamp, _rowid",
        "first_event": f"{logs} SELECT _rowid, {logs_clean} FROM logs ORDER BY timestamp, _rowid LIMIT 1",
        "most_least_by_app": most_least.format(logs=logs, by="app"),
        "most_least_by_level": most_least.format(logs=logs, by="level"),
        "avg_value_by_app": "SELECT concat('app_', user_id % 10) AS app, round(avg(value), 4) AS avg_value, count(value) AS n FROM events GROUP BY 1",
        "totals": "SELECT round(sum(value), 2) AS total, count(value) AS n, round(avg(value), 4) AS average FROM events",
    }
    for name, (statement, _) in PASS_THROUGH.items():
        found[name] = statement.replace("@", "")
    return found | _training_data()[1]
