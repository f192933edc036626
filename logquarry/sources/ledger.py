"""Reloading log files without doubling their records (X7): a ledger of what a store has taken in.

The ledger is a folder of Parquet files next to the table, one row per file and load: path, size, change time and a digest
of the lines.  Files are held against it before any of them is read: one of known path, size and change time is skipped
unread, one that was only touched is skipped by its digest.  A load is entered as begun with the first row id that it
will use, and as done when its rows are stored; the rows of one that broke off are removed before the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.schema import ROW_ID
from logquarry.sources.store import LogStore
from logquarry.sources.text_logs import escape_glob, read_log_lines, read_logs

BEGUN, DONE, VOID = "begun", "done", "void"
_ENTRY = "load string, state string, file string, size long, changed timestamp, digest string, start long"
_OF_FILE = ["file", "size", "changed"]


def entries(store: LogStore) -> DataFrame:
    """All entries of a store's ledger, oldest first in no particular order; none for a new one."""
    spark = store.spark
    return spark.read.schema(_ENTRY).parquet(store.ledger) if store._exists(store.ledger) else spark.createDataFrame([], _ENTRY)


def _enter(store: LogStore, rows: DataFrame, load: str, state: str, start: int) -> None:
    filled = rows.withColumns({"load": F.lit(load), "state": F.lit(state), "start": F.lit(start).cast("long")})
    filled.select(*[c.split()[0] for c in _ENTRY.split(", ")]).write.mode("append").parquet(store.ledger)


def _files(store: LogStore, path: str) -> DataFrame:
    """file, path, size, changed of the files below a path; their contents are not read."""
    found = store.spark.read.format("binaryFile").load(path)
    return found.select(
        F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("changed")
    )


def _digests(store: LogStore, paths: list[str]) -> DataFrame:
    """file, digest: of all lines of each file, whatever the splits in which they are read."""
    lines = read_log_lines(store.spark, [escape_glob(p) for p in paths])
    sums = [F.sum(F.xxhash64(*seed, "value").cast("decimal(38,0)")).cast("string") for seed in ((), (F.lit("second"),))]
    return lines.groupBy("file").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums).alias("digest"))


def _undo_broken(store: LogStore) -> None:
    """Remove the rows of loads that broke off."""
    states = entries(store).groupBy("load").agg(
        F.max(F.when(F.col("state") != BEGUN, 1).otherwise(0)).alias("over"), F.min("start").alias("start")
    )
    for row in states.where("over = 0").orderBy("start").collect():  # at most one: a store has one writer
        if store.exists():
            store._delete(F.col(ROW_ID) >= F.lit(row["start"]))
        _enter(store, entries(store).where((F.col("load") == row["load"]) & (F.col("state") == BEGUN)), row["load"], VOID, row["start"])


def reload_logs(store: LogStore, path: str, on_bad: str = "fail") -> int:
    """Append the records of those files below a path (a file, a folder or a pattern) that the store has not taken in; how
    many records that were.

    A file is known by its path, size and change time, or by its path, size and digest.  One whose path is known with
    other contents raises, because its old records cannot be told from others.  An overwrite of the table empties the ledger;
    records that were deleted do not come back.
    """
    _undo_broken(store)
    done = entries(store).where(F.col("state") == DONE)
    fresh = _files(store, path).join(done, _OF_FILE, "left_anti")
    paths = [r["path"] for r in fresh.select("path").collect()]  # names only, as Spark's own listing
    if not paths:
        return 0
    # An empty file has no lines and so no row among the digests.
    read = fresh.drop("path").join(_digests(store, paths), "file", "left").fillna("0", ["digest"])
    touched = read.join(done, ["file", "size", "digest"], "left_semi")
    changed = read.join(done, ["file", "size", "digest"], "left_anti")
    known = changed.join(done.select("file"), "file", "left_semi").select("file").limit(5).collect()
    if known:
        raise ValueError(f"taken in before with other contents: {', '.join(r['file'] for r in known)}")
    load, start = uuid.uuid4().hex, store._next_id()
    _enter(store, changed, load, BEGUN, start)
    begun = entries(store).where((F.col("load") == load) & (F.col("state") == BEGUN)).select(*_OF_FILE, "digest")
    new = [r["path"] for r in _files(store, path).join(begun, _OF_FILE, "left_semi").select("path").collect()]
    records = read_logs(store.spark, [escape_glob(p) for p in new], on_bad, row_ids=True) if new else None
    if records is not None:
        store.insert(records, "append", ids=False)
    _enter(store, begun, load, DONE, start)
    if not touched.isEmpty():
        _enter(store, touched, uuid.uuid4().hex, DONE, start)
    return store._next_id() - start
