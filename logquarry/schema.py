"""The canonical log record."""

from pyspark.sql import types as T

# The column names and the level names of the log format.
LOG_COLUMNS = ("timestamp", "level", "app", "source_file", "line_number", "message")
LEVELS = ("INFO", "WARNING", "ERROR", "FATAL", "DEBUG")

# Timestamps carry no zone.  Every field is required; Parquet cannot enforce
# that, so operators.validate checks it as a job.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("app", T.StringType(), False),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("line_number", T.LongType(), False),
        T.StructField("message", T.StringType(), False),
    ]
)

# Zero-based, written once when a record is stored, never renumbered.
ROW_ID = "_rowid"
EVENT_DATE = "event_date"
DEFAULT_TABLE = "logs"
