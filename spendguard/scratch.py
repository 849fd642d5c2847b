"""Barriers between jobs: intermediate tables written to the cluster's shared folder.

A written table cuts lineage, survives lost executors, and carries its size, so the planner
broadcasts it only when it is below `spark.sql.autoBroadcastJoinThreshold` and shuffles otherwise.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_local_roots: dict[str, str] = {}


class _Scopes(threading.local):
    """Open scopes of a thread: a stream's micro-batches do not see those of the main program."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; in local mode, where all tasks share one disk, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spendguard-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/spendguard/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` to the shared folder and return the table read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if _scopes.open:
        _scopes.open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete barrier tables that no later job reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession):
    """Barrier tables that this thread writes inside are deleted at the end; `keep` writes one that stays."""
    paths: list[str] = []
    _scopes.open.append(paths)
    try:
        yield paths
    finally:
        _scopes.open.pop()
        delete(spark, *paths)


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """Write `df` as a barrier that outlives the current scope."""
    inner = _scopes.open.pop() if _scopes.open else None
    try:
        return materialise(df, name)
    finally:
        if inner is not None:
            _scopes.open.append(inner)


def tasks(spark: SparkSession) -> int:
    """Number of tasks for work whose cost does not show in its bytes."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, light: bool = False) -> DataFrame:
    """Deal out a table that sits in fewer files than there are cores; larger tables stay where they are.

    With `light`, for work of a few steps a row, to a part for each core only.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores:
        return df.repartition(cores if light else tasks(spark))
    return df


def dealt(df: DataFrame, *order: str, name: str = "dealt") -> DataFrame:
    """Write `df` in many files of about equal size, each sorted by `order`.

    Passes over the table use every core without dealing it out again, and tasks that read many rows of a group in a row
    prepare what belongs to the group once.
    """
    return materialise(df.repartition(tasks(df.sparkSession)).sortWithinPartitions(*order), name)


@contextmanager
def session_conf(spark: SparkSession, **settings):
    """Set session options (dots written as `__`) while a job is planned and run."""
    keys = {k.replace("__", "."): str(v) for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
