"""A log table, its text lines, questions and statements derived from an event table.

The texts run in Spark and in any engine with the same functions, so that a result
can be compared; `{ts}` is the event time cut to whole seconds and `{src}` the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.operators.sampling import render_line
from logquarry.schema import LOG_COLUMNS, ROW_ID

LOGS_SQL = """
SELECT event_id AS _rowid,
  {ts} AS timestamp,
  CASE WHEN event_id % 101 = 0 THEN 'FATAL' WHEN event_id % 103 = 0 THEN 'NOTICE'
       WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARNING'
       WHEN event_type = 'purchase' THEN 'DEBUG' ELSE 'INFO' END AS level,
  concat('app_', CAST(user_id % 10 AS STRING)) AS app,
  concat(event_type, '.py') AS source_file,
  event_id % 500 AS line_number,
  concat('user', CAST(user_id AS STRING), '@example.com from 10.0.',
         CAST(event_id % 256 AS STRING), '.', CAST(user_id % 256 AS STRING),
         CASE WHEN event_id % 7 = 0 THEN ' api_key=abcdefghijklmnop' ELSE '' END,
         CASE WHEN event_type = 'error' AND event_id % 4 <> 0 THEN concat(
           chr(10), 'Traceback (most recent call last):',
           chr(10), '  File "svc/entry.py", line ', CAST(event_id % 9 AS STRING), ', in main',
           chr(10), '    run()',
           chr(10), '  File "svc/job', CAST(event_id % 8 AS STRING), '.py", line 7, in run',
           chr(10), CASE event_id % 3 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'KeyError' ELSE 'app.TimeoutError' END,
           CASE event_id % 5 WHEN 0 THEN concat(': over the limit', chr(10), 'detail: see the job notes', chr(10), 'retry: no')
             WHEN 1 THEN '' ELSE ': boom' END)
              WHEN event_type = 'error' THEN CASE event_id % 8 WHEN 0 THEN concat(' gave up', chr(10), 'Disk write FAILED on vol1')
                ELSE ' request failed' END ELSE '' END) AS message
FROM {src}
"""

QUESTIONS_SQL = """
SELECT event_id AS question_id,
  {ts} AS asked_at,
  concat('app_', CAST(user_id % 10 AS STRING)) AS app,
  CASE event_id % 8
    WHEN 0 THEN concat('how many records did job', CAST(user_id AS STRING), ' write')
    WHEN 1 THEN concat('why is queue ', CAST(event_id AS STRING), ' stuck')
    WHEN 2 THEN concat('what is the root cause, and list the records of job', CAST(user_id AS STRING))
    WHEN 3 THEN concat('please rename node ', CAST(event_id AS STRING)) WHEN 4 THEN '   '
    WHEN 5 THEN 'AVERAGE value BY LEVEL' WHEN 6 THEN concat('mail ops', CAST(user_id AS STRING), '@example.com the rota')
    ELSE concat('diagnose job', CAST(user_id AS STRING), ' please') END AS question
FROM {src}
"""

STATEMENTS_SQL = """
SELECT event_id AS query_id,
  CASE event_id % 18
    WHEN 0 THEN concat('SELECT app FROM logs WHERE line_number = ', CAST(event_id % 500 AS STRING))
    WHEN 1 THEN concat('  select app, max(line_number) from logs where line_number < ', CAST(event_id AS STRING), ' group by app')
    WHEN 2 THEN concat('WITH few AS (SELECT * FROM logs LIMIT ', CAST(event_id AS STRING), ') SELECT app FROM few')
    WHEN 3 THEN 'EXPLAIN SELECT app FROM logs'
    WHEN 4 THEN concat('delete from logs where line_number > ', CAST(event_id AS STRING))
    WHEN 5 THEN concat('SELECT app FROM logs LIMIT ', CAST(event_id AS STRING), '; SHOW TABLES')
    WHEN 6 THEN concat('SELECT app FROM logs -- job ', CAST(user_id AS STRING))
    WHEN 7 THEN concat('WITH x AS (SELECT ', CAST(user_id AS STRING), ') INSERT INTO logs SELECT * FROM x')
    WHEN 8 THEN '   '
    WHEN 9 THEN concat('SELECT app FROM logs WHERE message LIKE ''%grant ', CAST(user_id AS STRING), '%''')
    WHEN 10 THEN concat('VACUUM logs RETAIN ', CAST(event_id AS STRING), ' HOURS')
    WHEN 11 THEN concat('SELECT app, ', CAST(event_id AS STRING), ' /* which */ FROM logs')
    WHEN 12 THEN concat('SELECT java_method(''java.lang.Math'', ''abs'', -', CAST(event_id AS STRING), ')')
    WHEN 13 THEN concat('SELECT app FROM parquet.`/data/', CAST(event_id AS STRING), '`')
    WHEN 14 THEN concat('SELECT TRANSFORM(app) USING ''job', CAST(event_id AS STRING), ''' AS (x) FROM logs')
    WHEN 15 THEN concat('SELECT * FROM `org.example.Reader`.`job', CAST(event_id AS STRING), '`')
    WHEN 16 THEN concat('SELECT * FROM reader.`s3a://logs/', CAST(event_id AS STRING), '`')
    ELSE concat('SELECT transform(parts, x -> x + ', CAST(event_id AS STRING), ') FROM logs JOIN jobs USING (app)') END AS query
FROM {src}
"""

CONDITIONS_SQL = """
SELECT event_id AS filter_id,
  CASE event_id % 9
    WHEN 0 THEN concat('line_number > ', CAST(event_id AS STRING))
    WHEN 1 THEN concat('app = ''app_', CAST(user_id AS STRING), ''' or level is null')
    WHEN 2 THEN concat('line_number = ', CAST(event_id AS STRING), '; select 1')
    WHEN 3 THEN concat('message = ''copy of ', CAST(user_id AS STRING), '''')
    WHEN 4 THEN ' '
    WHEN 5 THEN concat('reflect(''java.lang.Math'', ''abs'', ', CAST(event_id AS STRING), ') > 0')
    WHEN 6 THEN concat('updated_by = ', CAST(user_id AS STRING))
    WHEN 7 THEN concat('app IN (SELECT TRANSFORM(app) USING ''job', CAST(event_id AS STRING), ''' AS (x) FROM logs)')
    ELSE concat('true /* ', CAST(event_id AS STRING), ' */') END AS condition
FROM {src}
"""

SPARK_TS = "CAST(date_trunc('second', ts) AS TIMESTAMP_NTZ)"


def from_events(spark: SparkSession, events: DataFrame, text: str) -> DataFrame:
    return spark.sql(text.replace("{ts}", SPARK_TS).replace("{src}", "{events}"), events=events)


def logs_from_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    return from_events(spark, events, LOGS_SQL)


def questions_from_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    return from_events(spark, events, QUESTIONS_SQL)


def statements_from_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    return from_events(spark, events, STATEMENTS_SQL)


def text_rows(logs: DataFrame) -> DataFrame:
    """Records as raw log text, with noise the parser must drop: one orphan line and a
    blank one before the first record of each app, and blank lines inside messages."""
    noisy = F.regexp_replace(render_line(), F.lit("\n"), F.lit("\n  \t\n"))
    text = logs.select("app", F.col(ROW_ID).alias("seq"), noisy.alias("value"))
    orphans = text.select("app").distinct().select(
        "app", F.lit(-1).cast("bigint").alias("seq"), F.lit("left over from before\n\n").alias("value")
    )
    return text.unionByName(orphans)


def log_columns(df: DataFrame) -> DataFrame:
    return df.select(*LOG_COLUMNS)
