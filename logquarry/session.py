"""Session settings, and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "logquarry", master: str | None = None, **settings) -> SparkSession:
    """A session with the settings the jobs assume; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may go without one; it gets a temporary folder, since
    there every executor thread sees the same disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="logquarry-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jvm_path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder, removed when the application ends.

    Lazy results read from such paths, so they stay until then.  A driver that is killed leaves its folder behind; it
    has the name of the application.
    """
    root = f"{shared_folder(spark)}/logquarry-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        fs, jvm_path = file_system(spark, root)
        fs.mkdirs(jvm_path)
        fs.deleteOnExit(jvm_path)  # needs a folder that is there
        _ROOTS.add(root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


_ROOTS: set[str] = set()


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Inside, the shuffle files of a query go from the executors' disks as soon as it ends, not when the driver happens to
    collect its garbage.  For work in steps, each of which is settled."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def settle(df: DataFrame, label: str, **options) -> DataFrame:
    """A small derived table written to the shared folder, with options of the Parquet writer, and read back.

    The planner then knows its true size before it starts: it broadcasts the table if that is
    under the session's limit, and does not shuffle the large side of a join first to
    find out.  The table is also not worked out again when an executor is lost.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
