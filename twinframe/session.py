"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Folders that this process has named under the shared folder and not released yet.
_named: list[str] = []

# UTC keeps timestamp text equal on every cluster; AQE sizes and splits shuffle partitions at run time.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "twinframe", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local session, where driver and
    executors are one machine, may fall back on a temporary folder.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="twinframe-")
        spark.conf.set(CHECKPOINT_DIR, root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _named.append(path)
    return path


def named_paths(since: Iterable[str] = ()) -> list[str]:
    """Scratch folders not released yet, without those of ``since``."""
    before = set(since)
    return [p for p in _named if p not in before]


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch folders. Whatever reads them must be done."""
    for path in paths:
        if path in _named:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            _named.remove(path)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Rows that a write in here shuffles are deleted when it is done, not when the driver next collects garbage.

    Only for writes: a frame made in here would lose its shuffled rows after every action on it.
    """
    before = spark.conf.get(RELEASE_SHUFFLES, None)
    spark.conf.set(RELEASE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE_SHUFFLES) if before is None else spark.conf.set(RELEASE_SHUFFLES, before)


def stage(df: DataFrame, label: str, *more: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later readers prune columns and need no recompute.

    The rows of ``more``, of the same columns, are put beside those of ``df``, one frame after the other. ``options`` are
    those of the Parquet writer.
    """
    path = scratch_path(df.sparkSession, label)
    for part in (df, *more):
        with shuffles_released(df.sparkSession):
            part.write.mode("append").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
