"""Failures over a log table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.functions import patterns as P
from logquarry.functions import traces as X
from logquarry.functions.expressions import once
from logquarry.functions.redaction import scrub, scrub_text
from logquarry.operators.ranking import join_groups, top_k_per_group
from logquarry.operators.sampling import context_payload, log_lines, sample_context
from logquarry.schema import ROW_ID

FAILURE_LEVELS = ("ERROR", "FATAL")


def extract_tracebacks(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per traceback, numbered from 0 inside its text."""
    found = df.select(*keys, F.posexplode(X.tracebacks(F.col(text))).alias("trace_no", "trace"))
    return found.withColumn("trace_no", F.col("trace_no").cast("long"))


def extract_failure_lines(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per failure line of the texts without a traceback."""
    lines = df.where(X.failure_kind(F.col(text)) == "lines")
    found = lines.select(*keys, F.posexplode(X.failure_lines(F.col(text))).alias("line_no", "line"))
    return found.withColumn("line_no", F.col("line_no").cast("long"))


def failure_kinds(df: DataFrame, text: str, by: Sequence[str]) -> DataFrame:
    """Texts per failure kind."""
    kind = X.failure_kind(F.col(text)).alias("kind")
    return df.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("n"))


def _fields(trace: Column) -> Column:
    """Type, message, innermost frame and all frames of a traceback."""
    unknown = F.lit("unknown")

    def parts(t: Column) -> Column:
        inner = F.try_element_at(t["frames"], F.lit(-1))
        place = F.concat(inner["file"], F.lit(":"), inner["line"].cast("string"), F.lit(" in "), inner["function"])
        return F.struct(
            F.coalesce(t["exc"]["type"], unknown).alias("exc_type"),
            F.coalesce(t["exc"]["message"], F.lit("")).alias("exc_message"),
            F.coalesce(place, unknown).alias("frame"),
            t["frames"].alias("frames"),
        )

    return once(F.struct(X.exception(trace).alias("exc"), X.frames(trace).alias("frames")), parts)


def exceptions(logs: DataFrame) -> DataFrame:
    """One row per traceback with its type, message, innermost frame and signature."""
    wanted = [c for c in (ROW_ID, "timestamp", "level", "app") if c in logs.columns]
    traces = extract_tracebacks(logs, "message", wanted)
    parsed = traces.withColumn("_fields", _fields(F.col("trace"))).select(*traces.columns, "_fields.*")
    return parsed.withColumn("signature", F.concat("exc_type", F.lit(" at "), "frame"))


def exception_profile(excs: DataFrame) -> DataFrame:
    """Count, first and last sight, and number of apps per signature.

    Counted per app first: the apps of a signature are then rows, never a list.
    """
    per_app = excs.groupBy("signature", "exc_type", "frame", "app").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )
    total = per_app.groupBy("signature", "exc_type", "frame").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("apps"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    return scrub(total)


def top_exceptions(excs: DataFrame, k: int = 3) -> DataFrame:
    """The `k` most frequent signatures of each app."""
    counts = excs.groupBy("app", "signature").agg(F.count(F.lit(1)).alias("n"))
    top = top_k_per_group(counts, ["app"], [F.desc("n"), F.asc("signature")], k)
    return scrub(top.select("app", "rank", "signature", "n"))


def recent_failures(logs: DataFrame, k: int = 20) -> DataFrame:
    """The newest `k` failed records of each app, newest first."""
    failed = logs.where(F.col("level").isin(*FAILURE_LEVELS))
    top = top_k_per_group(failed, ["app"], [F.desc("timestamp"), F.desc(ROW_ID)], k)
    return scrub(top.select("app", "rank", ROW_ID, "timestamp", "level", "source_file", "line_number", "message"))


def severity_rank(level):
    """Fatal first.  Levels outside the format's own come last."""
    order = ("FATAL", "ERROR", "WARNING", "INFO", "DEBUG")
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(level == name, i).otherwise(rank)
    return rank


def telling_exceptions(excs: DataFrame, k: int = 3) -> DataFrame:
    """Extension: the `k` gravest and then newest tracebacks of each signature."""
    order = [severity_rank(F.col("level")).asc(), F.desc("timestamp"), F.desc(ROW_ID), F.asc("trace_no")]
    top = top_k_per_group(excs, ["signature"], order, k)
    return scrub(top.select("signature", "rank", ROW_ID, "timestamp", "level", "app", "trace"))


_RECORD, _CAUSE, _PLACE, _LINE = "record", "cause", "place", "line"
_NO_FACTS = "array<struct<what:string,name:string,said:string>>"


def _facts(message: Column) -> Column:
    """What a failed record tells: that it failed, the exception and the innermost frame of each of its tracebacks, and
    without one its failure lines."""

    def fact(what: str, name: Column, said: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), name.alias("name"), said.alias("said"))

    blank, none = F.lit(""), F.array().cast(_NO_FACTS)
    traces = F.transform(
        X.tracebacks(message),
        lambda t: once(
            _fields(t), lambda x: F.array(fact(_CAUSE, x["exc_type"], x["exc_message"]), fact(_PLACE, x["frame"], blank))
        ),
    )
    lines = F.when(X.failure_kind(message) == "lines", X.failure_lines(message))
    return F.concat(
        F.array(fact(_RECORD, blank, blank)), F.coalesce(F.flatten(traces), none),
        F.coalesce(F.transform(lines, lambda x: fact(_LINE, x, blank)), none),
    )


def _fact_counts(logs: DataFrame, group: Sequence[str]) -> DataFrame:
    """How often each fact stands in the failed records of each group."""
    failed = logs.where(F.col("level").isin(*FAILURE_LEVELS))
    facts = failed.select(*group, F.inline(_facts(F.col("message"))))
    return facts.groupBy(*group, "what", "name", "said").agg(F.count(F.lit(1)).alias("n"))


def affected_places(logs: DataFrame, group: Sequence[str] = ("app",)) -> DataFrame:
    """Every innermost frame of each group's failed records: the group, frame, traces.

    All of them, as rows; the analysis of `diagnose` names the commonest.
    """
    places = _fact_counts(logs, group).where(F.col("what") == _PLACE)
    return scrub(places.select(*group, F.col("name").alias("frame"), F.col("n").alias("traces")))


def diagnose(logs: DataFrame, group: Sequence[str] = ("app",), components: int = 5) -> DataFrame:
    """One row per group with failed records: the group, subject, failures, analysis.

    The analysis states what failed, the commonest cause and where: the exception of most tracebacks, or without any
    the commonest failure line; and the innermost frames, `components` of them by name and the number of the others, which
    `affected_places` lists.
    Only facts found in the records; advice on repair is left out.  Records are read once, and everything is taken
    from the counts of their facts, ranked in one selection.  Rows without a group form one of their own.
    """
    counts = _fact_counts(logs, group)
    # Not filtered by kind before: a filter would be pushed below the counts, and the records be read twice.
    ranked = top_k_per_group(counts, [*group, "what"], [F.desc("n"), F.asc("name"), F.asc("said")], max(components, 1))

    def first(what: str, text: Column) -> Column:
        return F.max(F.when((F.col("what") == what) & (F.col("rank") == 1), text))

    number = F.col("n").cast("string")
    said = F.when(F.col("said") != "", F.concat(F.lit(": "), "said")).otherwise("")
    place = F.when((F.col("what") == _PLACE) & (F.col("rank") <= components), F.struct("rank", "name"))
    tops = ranked.groupBy(*group).agg(
        first(_CAUSE, F.concat("name", said, F.lit(" ("), number, F.lit(" traces)"))).alias("cause"),
        first(_LINE, F.concat(F.btrim("name", F.lit(P.BLANKS)), F.lit(" ("), number, F.lit(" lines)"))).alias("line"),
        F.transform(F.array_sort(F.collect_list(place)), lambda r: r["name"]).alias("places"),
    )
    sums = counts.groupBy(*group).agg(
        F.sum(F.when(F.col("what") == _RECORD, F.col("n"))).alias("failures"),
        F.count_if(F.col("what") == _PLACE).alias("n_places"),
    )
    found = join_groups(sums, tops, group, "left")
    subject = F.concat_ws(" on ", *[F.coalesce(F.col(c).cast("string"), F.lit("(none)")) for c in group])
    others = F.col("n_places") - components
    places = F.when(F.size("places") > 0, F.array_join("places", ", "))
    text = F.concat(
        F.lit("- **Primary Issue**: "), F.col("failures").cast("string"), F.lit(" failed records in "), subject,
        F.lit("\n- **Root Cause**: "), F.coalesce("cause", "line", F.lit(P.NO_FAILURE)),
        F.lit("\n- **Affected Components/Files**: "), F.coalesce(places, F.lit("none identified")),
        F.when(others > 0, F.concat(F.lit(" and "), others.cast("string"), F.lit(" more"))).otherwise(""),
    )
    return found.select(*group, subject.alias("subject"), "failures", scrub_text(text).alias("analysis"))


def failure_evidence(logs: DataFrame, group: Sequence[str] = ("app",)) -> DataFrame:
    """The telling lines of each group's failed records (E4), as one redacted text: the group, group_lines,
    kept_lines, payload."""
    failed = logs.where(F.col("level").isin(*FAILURE_LEVELS))
    sample = sample_context(log_lines(failed, group), group, ["timestamp", ROW_ID, "pos"])
    return context_payload(sample, group)


def diagnose_with_evidence(logs: DataFrame, group: Sequence[str] = ("app",)) -> DataFrame:
    """`diagnose` with the payload of `failure_evidence` as a column more."""
    evidence = failure_evidence(logs, group).select(*group, F.col("payload").alias("evidence"))
    return join_groups(diagnose(logs, group), evidence, group, "left")
