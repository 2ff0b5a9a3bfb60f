"""Session helpers: local session for tests and reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "firstborn") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    cores = cpus or os.cpu_count() or 1
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local master, where the driver and the executors are one process,
    may fall back to a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="firstborn-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


_SCOPE: ContextVar[list[str] | None] = ContextVar("table_scope", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def persist_reliably(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from the table.

    Losing executors loses nothing.  Unlike a checkpoint the table keeps its
    true size, so later joins are planned on it, and is read by column.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.option("compression", "lz4").parquet(path)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def table_scope():
    """Collect the tables written inside, so that a loop can drop them later.

    Only the innermost scope of the same thread of control sees a table; what an inner
    scope leaves belongs to the outer one afterwards.
    """
    outer, scope = _SCOPE.get(), []
    token = _SCOPE.set(scope)
    try:
        yield scope
    finally:
        _SCOPE.reset(token)
        if outer is not None:
            outer.extend(scope)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables no later plan reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        target = hadoop(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
