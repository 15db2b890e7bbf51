"""Session helpers: a tuned local session for tests/bench and a shared scratch area."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "regionpulse") -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("REGIONPULSE_DRIVER_MEMORY", "16g"))
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_PRIVATE: list[tempfile.TemporaryDirectory] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster-wide checkpoint folder named by ``spark.checkpoint.dir``.

    The directory is also registered with the SparkContext so that
    ``DataFrame.checkpoint()`` writes there.  Where the setting is missing, a private
    folder (removed when the process ends) is made for a ``local`` master only: on a
    cluster every executor would write to its own disk, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(sc.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {sc.master})")
        _PRIVATE.append(tempfile.TemporaryDirectory(prefix="regionpulse-ckpt-"))
        configured = _PRIVATE[-1].name
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def is_local(master: str) -> bool:
    """Whether driver and executors are one process and so share the local disk."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/regionpulse-{name}-{uuid.uuid4().hex[:12]}"


#: the written tables of each open scope, innermost last; every thread has its own scopes
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are removed at the end, except those it is
    told to ``keep`` for the result, which belong to the scope around this one (without one,
    they stay).  What leaves the scope must read kept tables only.  Scopes of jobs that run
    side by side in threads of one process never mix."""
    written: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), written))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        remove(spark, written)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables wherever they are stored."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(conf).delete(place, True)


def files_exist(spark: SparkSession, files: list[str]) -> bool:
    """Whether all of a table's files (``DataFrame.inputFiles``) are still stored."""
    hadoop, uri = spark._jvm.org.apache.hadoop.fs, spark._jvm.java.net.URI
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [hadoop.Path(uri(f)) for f in files]
    return all(path.getFileSystem(conf).exists(path) for path in paths)


def materialize(df, name: str, keep: bool = False, large_rows: bool = False):
    """Write ``df`` once to the shared checkpoint folder and return the re-read table.

    Used where a (small, derived) table has several consumers: Spark would otherwise
    re-expand and recompute its whole plan for each of them.  The written table also
    cuts the lineage, so a lost executor costs one stage, not the whole chain.  Inside
    ``scratch`` the table lives as long as that scope, with ``keep`` as long as the one around it.
    ``large_rows`` (megabytes a row) are written in small row groups: a reading task holds up to
    4096 rows of a group at once, which would be all rows of a file."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    sizes = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1} if large_rows else {}
    df.write.options(**sizes).parquet(path)
    scopes = _SCOPES.get()
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    return spark.read.parquet(path)
