"""Written tables that cut lineage, in the folder the cluster shares for it."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_INSIDE: WeakKeyDictionary[SparkSession, tuple[int, str | None]] = WeakKeyDictionary()  # users, and the caller's setting


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the context's checkpoint folder, else (local master only) a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return tempfile.mkdtemp(prefix="rankwell-")
    raise RuntimeError(
        f"intermediate tables need a folder that all machines of {master} share: set spark.checkpoint.dir or "
        "call SparkContext.setCheckpointDir"
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffle_clean_up(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go as soon as the query that made them has ended, not when the driver collects garbage.

    Threads that share a session may be inside together: the last one to leave puts the caller's setting back.
    """
    with _LOCK:
        users, before = _INSIDE.get(spark, (0, None))
        if not users:
            before = spark.conf.get(_CLEAN_UP, None)
            spark.conf.set(_CLEAN_UP, "true")
        _INSIDE[spark] = (users + 1, before)
    try:
        yield
    finally:
        with _LOCK:
            users, before = _INSIDE.pop(spark)
            if users > 1:
                _INSIDE[spark] = (users - 1, before)
            elif before is None:
                spark.conf.unset(_CLEAN_UP)
            else:
                spark.conf.set(_CLEAN_UP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: its plan is not run again by every use, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffle_clean_up(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
