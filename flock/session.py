"""Spark session helpers.

Library code never creates its own session: operators take DataFrames and
use ``df.sparkSession``.  ``build_session`` is for tests, the bench and the
command line.  Lineage is cut with reliable ``checkpoint()`` into the shared
folder named by ``spark.checkpoint.dir``; a scratch folder is chosen only
when the setting is missing and Spark runs in local mode (tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Whether Spark deletes a query's shuffle files as soon as the query ends.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "flock") -> SparkSession:
    """Session with the settings every query here assumes.

    UTC session time zone (inputs are ``timestamp_ntz``), AQE with partition
    coalescing and skew-join splitting, Arrow for pandas exchange, UI off.
    """
    master = master or os.environ.get("FLOCK_MASTER", "local[8]")
    parts = shuffle_partitions or os.environ.get("FLOCK_SHUFFLE_PARTITIONS")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        # no Python call-site capture on every DataFrame call (a stack walk per call)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FLOCK_DRIVER_MEMORY", "16g"))
    )
    if parts:  # else the session's own setting stays: AQE merges partitions, but never adds any
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, reading it from the session first.

    Only when nothing is configured and the master is local (tests, bench)
    is a fresh scratch folder created.  On a cluster an unset
    ``spark.checkpoint.dir`` is an error: a machine-local folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set; point it at a shared folder (HDFS/S3/...)")
        configured = tempfile.mkdtemp(prefix="flock-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set(CHECKPOINT_CONF, configured)
    sc.setCheckpointDir(configured)
    return configured


class Intermediates:
    """The tables that ``materialize`` writes while a scope is open."""

    def __init__(self, outer: "Intermediates | None"):
        self.outer = outer
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, a table of this scope, outlives it: it belongs to the scope around, if there is one."""
        if self.outer is not None and any(t is df for t in self.tables):
            self.outer.tables.append(df)
        self.forget(df)
        return df

    def forget(self, df: DataFrame) -> None:
        self.tables = [t for t in self.tables if t is not df]

    def close(self) -> None:
        while self.tables:
            release(self.tables.pop())


_SCOPE: ContextVar[Intermediates | None] = ContextVar("flock_intermediates", default=None)


@contextmanager
def intermediates() -> Iterator[Intermediates]:
    """A scope that owns every table ``materialize`` writes inside it and deletes them at its end, but for
    those it was told to ``keep``.  A lazy result still reads its tables: write or keep it first.  Scopes nest;
    threads started inside take part when run in a copy of the context (``contextvars.copy_context``)."""
    scope = Intermediates(_SCOPE.get())
    token = _SCOPE.set(scope)
    try:
        yield scope
    finally:
        scope.close()
        _SCOPE.reset(token)


def release(*dfs: DataFrame) -> None:
    """Delete tables that ``materialize`` returned: whatever read them has been written.  Other frames are
    left alone."""
    for df in dfs:
        path = df.__dict__.pop("_flock_table", None)
        if path is None:
            continue
        scope = _SCOPE.get()
        while scope is not None:
            scope.forget(df)
            scope = scope.outer
        sc = df.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through a table written in the shared checkpoint folder.

    The plan runs once, its result is written as parquet under
    ``spark.checkpoint.dir`` and read back: later consumers scan files
    (with column pruning, filter pushdown and real size statistics for AQE)
    instead of replaying the upstream plan, and a lost executor only re-reads
    the files.  (An eager ``Dataset.checkpoint`` would compute the plan twice:
    once for its count and once more to write the checkpoint.)

    The write is a query of its own, which nothing reads again, so its shuffle files
    go when it ends and not when the driver next collects garbage."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)
    out = spark.read.parquet(path)
    out._flock_table = path
    if (scope := _SCOPE.get()) is not None:
        scope.tables.append(out)
    return out
