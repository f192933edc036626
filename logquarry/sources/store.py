"""The persisted log table: insert, lookup and delete.

Every write puts its rows into a new folder and then enters a new version of the table: a small file that lists the folders
of all days.  The session's catalog has one table of partitions per version, and a view over the newest under the name of
the store.  Nothing is moved or removed, so a reader keeps the version it began with, and a write that breaks off leaves
the table as it was.  Partitions are days when there is a timestamp, so date filters prune, and a delete rewrites only
the days it touches.  ``vacuum`` removes what the newest version does not use.
"""

from __future__ import annotations

import json
import logging
import os
import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.functions import guards, statements
from logquarry.functions.redaction import scrub
from logquarry.schema import DEFAULT_TABLE, EVENT_DATE, ROW_ID
from logquarry.session import file_system, scratch_path, settle
from logquarry.sources.tables import read_table_file
from logquarry.sources.text_logs import count_records, escape_glob, read_logs

log = logging.getLogger(__name__)

_NO_DATE = "1970-01-01"
_WRITE = "_write_id"  # partition column: the write that brought a row
_AT_ONCE = 500  # partitions entered by one statement
_ID_BITS = 33  # monotonically_increasing_id holds the row's place in its partition in the lower bits
_RANGE_BITS = 10  # partitions whose rows are numbered in one task


def with_row_ids(df: DataFrame, start: int = 0) -> DataFrame:
    """`df` with contiguous ids from `start`, in the order of its rows.

    The rows are written once to the shared folder together with their partition and
    place.  Counting and numbering then read the same files, so both see the
    same rows even if an executor is lost in between.  Offsets are one row per partition, summed in ranges.
    """
    staged_path = scratch_path(df.sparkSession, "row-ids")
    row = F.monotonically_increasing_id()
    df.withColumn("_row", row).write.parquet(staged_path)
    staged = df.sparkSession.read.parquet(staged_path).withColumn("_part", F.shiftright("_row", _ID_BITS))
    # Partitions are numbered in ranges: a running sum inside each range, and one over the few ranges on the driver.
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    sizes = settle(sizes.withColumn("range", F.shiftright("_part", _RANGE_BITS)), "sizes")
    totals = dict(sizes.groupBy("range").agg(F.sum("n")).collect())
    starts, total = [], 0
    for i in range(max(totals, default=-1) + 1):
        starts.append(total)
        total += totals.get(i, 0)
    before = Window.partitionBy("range").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.element_at(F.lit(starts or [0]).cast("array<bigint>"), (F.col("range") + 1).cast("int"))
    offsets = sizes.select("_part", (base + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("offset"))
    place = F.col("_row") - F.shiftleft(F.col("_part"), _ID_BITS)
    numbered = staged.join(settle(offsets, "offsets"), "_part").withColumn(ROW_ID, F.lit(start) + F.col("offset") + place)
    return numbered.select(ROW_ID, *[F.col(f"`{c}`") for c in df.columns])


class LogStore:
    """A log table under `path`, known to SQL as `table`."""

    def __init__(self, spark: SparkSession, path: str, table: str = DEFAULT_TABLE) -> None:
        self.spark = spark
        self.table = table
        self.path = f"{path.rstrip('/')}/{table}"
        self.refresh()

    def refresh(self) -> None:
        """Show the newest version in this session's catalog; needed after another session's write."""
        number, version = self._newest()
        if version and number > self._shown():
            self._show(number, version)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def df(self) -> DataFrame:
        return self.spark.table(self.table)

    # -- writing -------------------------------------------------------------

    def insert(self, data: DataFrame | str | os.PathLike, mode: str = "ignore", ids: bool = True) -> None:
        """Store a frame, or a CSV, JSON, JSONL or Parquet file.

        With ``ignore``, the default, nothing happens if the table is there; ``append``
        numbers on from the highest id; ``overwrite`` starts again at 0.  A frame may bring
        its own ids with ``ids=False``.  The table has one writer at a time.
        """
        if mode not in ("ignore", "append", "overwrite"):
            raise ValueError(f"unknown mode {mode!r}")
        if isinstance(data, (str, os.PathLike)):
            data = read_table_file(self.spark, os.fspath(data))
        elif not isinstance(data, DataFrame):
            raise ValueError(f"a frame or a path is needed, not {type(data).__name__}")
        self.refresh()
        if mode == "ignore" and self.exists():
            log.warning("table %s exists, nothing inserted", self.table)
            return
        start = self._next_id() if mode == "append" else 0
        if ids:
            data = with_row_ids(data, start)
        elif start:
            data = data.withColumn(ROW_ID, F.col(ROW_ID) + start)
        self._write(data, mode)

    def ingest_log_file(self, path: str | os.PathLike, mode: str = "ignore", on_bad: str = "fail") -> int:
        """Parse and store a text log; the number of records parsed.

        The count is that of the file even if the table was there and nothing was stored.
        """
        literal = escape_glob(os.fspath(path))
        if mode == "ignore" and self.exists():
            log.warning("table %s exists, nothing inserted", self.table)
            return count_records(self.spark, literal, on_bad)
        records = read_logs(self.spark, literal, on_bad, row_ids=True)
        seen = Observation()
        self.insert(records.observe(seen, F.count(F.lit(1)).alias("n")), mode, ids=False)
        return seen.get["n"]

    def _next_id(self) -> int:
        if not self.exists():
            return 0
        top = self.df().agg(F.max(ROW_ID)).first()[0]
        return 0 if top is None else top + 1

    def _write(self, data: DataFrame, mode: str) -> None:
        _, version = self._newest()
        columns, days = _days(data)
        folders, ledger, schema = [], self.ledger, columns.schema
        if mode == "append" and version:
            schema = T.StructType.fromJson(version["schema"])
            if sorted(columns.columns) != sorted(schema.names):
                raise ValueError(f"columns {columns.columns} do not match those of the table, {schema.names}")
            columns = columns.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])
            folders = version["folders"]
        elif version:
            ledger = f"{self.path}/ledger-{uuid.uuid4().hex}"  # a new table has taken in no files
        self._commit(schema, folders + self._store_rows(columns, days), ledger)

    def _store_rows(self, columns: DataFrame, days: bool) -> list[list[str | None]]:
        """Write rows to a new folder: day (none without days) and write for each partition."""
        write = uuid.uuid4().hex
        folder = f"{self.path}/{_WRITE}={write}"
        if not days:
            columns.write.parquet(folder)
            return [[None, write]]
        columns.write.partitionBy(EVENT_DATE).parquet(folder)
        return [[n.split("=", 1)[1], write] for n in self._names(folder) if n.startswith(f"{EVENT_DATE}=")]

    def _commit(self, schema: T.StructType, folders: list, ledger: str) -> None:
        """Enter a new version, which from then on is the table, and show it."""
        number = max(self._numbers(), default=0) + 1
        version = {"schema": schema.jsonValue(), "folders": folders, "ledger": ledger}
        self._create(f"{self.path}/versions/{number}", json.dumps(version))
        self._show(number, version)

    # -- versions ------------------------------------------------------------

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.path}/versions") if n.isdigit())

    def _newest(self) -> tuple[int, dict | None]:
        """Number and contents of the newest version that was entered wholly; 0 and none for a new store."""
        for number in reversed(self._numbers()):
            try:
                return number, json.loads(self._read(f"{self.path}/versions/{number}"))
            except ValueError:  # its writer was lost, or is at it
                continue
        return 0, None

    def _shown(self) -> int:
        """The version that the catalog shows."""
        if not self.exists():
            return 0
        return int(self.spark.sql(f"SHOW TBLPROPERTIES {self.table} ('version')").first()["value"])

    def _show(self, number: int, version: dict) -> None:
        """A table of the version's partitions, and then, in one step, the view over it.

        The table of the version before stays for those who read it; the one before that leaves the catalog.
        """
        schema, part = T.StructType.fromJson(version["schema"]), f"{self.table}__v{number}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        days = EVENT_DATE in schema.names
        keys = f"{EVENT_DATE}, {_WRITE}" if days else _WRITE
        self.spark.sql(f"DROP TABLE IF EXISTS {part}")
        self.spark.sql(
            f"CREATE TABLE {part} ({columns}, {_WRITE} string) USING parquet PARTITIONED BY ({keys}) LOCATION '{escaped(self.path)}'"
        )
        entries = []
        for day, write in version["folders"]:
            of_day, folder = (f"{EVENT_DATE}='{day}', ", f"/{EVENT_DATE}={day}") if day else ("", "")
            place = escaped(f"{self.path}/{_WRITE}={write}{folder}")
            entries.append(f"PARTITION ({of_day}{_WRITE}='{write}') LOCATION '{place}'")
        for i in range(0, len(entries), _AT_ONCE):
            self.spark.sql(f"ALTER TABLE {part} ADD {' '.join(entries[i : i + _AT_ONCE])}")
        names = ", ".join(f"`{n}`" for n in schema.names)
        before = self._shown()
        self.spark.sql(
            f"CREATE OR REPLACE VIEW {self.table} TBLPROPERTIES ('version' = '{number}') AS SELECT {names} FROM {part}"
        )
        for old in self._numbers():
            if old < before:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.table}__v{old}")

    def vacuum(self) -> None:
        """Remove the rows, lists and tables that the newest version does not use, among them rows that were deleted.

        For times without other readers and writers: it takes away what those of older versions read."""
        number, version = self._newest()
        if not version:
            return
        used = {f"{_WRITE}={write}": day for day, write in version["folders"]}
        days = {f"{_WRITE}={write}/{EVENT_DATE}={day}" for day, write in version["folders"]}
        for name in self._names(self.path):
            if name.startswith((f"{_WRITE}=", "ledger")):
                if name not in used and f"{self.path}/{name}" != version["ledger"]:
                    self._remove(f"{self.path}/{name}")
                elif used.get(name):
                    for day in self._names(f"{self.path}/{name}"):
                        if day.startswith(f"{EVENT_DATE}=") and f"{name}/{day}" not in days:
                            self._remove(f"{self.path}/{name}/{day}")
        for old in self._numbers():
            if old < number:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.table}__v{old}")
                self._remove(f"{self.path}/versions/{old}")

    # -- rows ----------------------------------------------------------------

    def _has_id(self, record_id: str):
        """Ids compare as text, so '01' is no id; a plain number is compared as one
        so that file statistics prune."""
        text = str(record_id)
        if re.fullmatch(r"0|-?[1-9][0-9]{0,18}", text, re.ASCII) and -(2**63) <= int(text) < 2**63:
            return F.col(ROW_ID) == F.lit(int(text)).cast("bigint")
        return F.lit(False)

    def get_by_id(self, record_id: str) -> DataFrame:
        """The redacted record, or no row."""
        return scrub(self.df().where(self._has_id(record_id)))

    def delete_record(self, record_id: str) -> None:
        self._delete(self._has_id(record_id))

    def delete_filter(self, condition: str) -> None:
        """Delete the rows for which `condition` is true; rows where it is null stay."""
        guards.check_filter(condition)
        statements.check_condition(self.spark, condition)
        self._delete(F.coalesce(F.expr(condition), F.lit(False)))

    def _delete(self, doomed) -> None:
        """A version in which the days with something to delete have new folders; all other days keep theirs."""
        self.refresh()
        _, version = self._newest()
        current = self.df()
        if EVENT_DATE not in current.columns:
            self._commit(current.schema, self._store_rows(current.where(~doomed), False), version["ledger"])
            return
        # One row per day with something to delete.
        days = [r[0] for r in current.where(doomed).select(EVENT_DATE).distinct().collect()]
        if not days:
            return
        columns, _ = _days(current.where(F.col(EVENT_DATE).isin(days)).where(~doomed))
        touched = {str(d) for d in days}
        others = [f for f in version["folders"] if f[0] not in touched]
        self._commit(current.schema, others + self._store_rows(columns, True), version["ledger"])

    # -- files ---------------------------------------------------------------

    @property
    def ledger(self) -> str:
        """Where the files that were taken in are listed; see `logquarry.sources.ledger`."""
        _, version = self._newest()
        return version["ledger"] if version else f"{self.path}/ledger"

    def _exists(self, path: str) -> bool:
        fs, jvm_path = file_system(self.spark, path)
        return fs.exists(jvm_path)

    def _names(self, folder: str) -> list[str]:
        fs, jvm_path = file_system(self.spark, folder)
        return [s.getPath().getName() for s in fs.listStatus(jvm_path)] if fs.exists(jvm_path) else []

    def _remove(self, path: str) -> None:
        fs, jvm_path = file_system(self.spark, path)
        fs.delete(jvm_path, True)

    def _create(self, path: str, text: str) -> None:
        """Write a small file that must not be there yet."""
        fs, jvm_path = file_system(self.spark, path)
        out = fs.create(jvm_path, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, path: str) -> str:
        fs, jvm_path = file_system(self.spark, path)
        stream = fs.open(jvm_path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def _days(data: DataFrame) -> tuple[DataFrame, bool]:
    """Rows ready to be written, and whether by day: a day that holds much of the table is split, small ones join."""
    if "timestamp" not in data.columns:
        return data, False
    day = F.to_date(F.col("timestamp").try_cast("timestamp_ntz"))
    data = data.withColumn(EVENT_DATE, F.coalesce(day, F.lit(_NO_DATE).cast("date")))
    return data.hint("rebalance", EVENT_DATE).sortWithinPartitions(EVENT_DATE, ROW_ID), True


def escaped(text: str) -> str:
    """For a literal in Spark SQL."""
    return text.replace("\\", "\\\\").replace("'", "\\'")
