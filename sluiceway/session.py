"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Repeated keys inside one JSON object are legal messages: the last one wins.
DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"
CHECKPOINT_DIR = "spark.checkpoint.dir"

_temporary: ContextVar[list[str] | None] = ContextVar("temporary", default=None)


def build_session(
    app_name: str = "sluiceway", master: str | None = None, **conf: str
) -> SparkSession:
    """Create (or get) a session with the settings the operators expect."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config(DUPLICATE_KEYS, "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def allow_duplicate_keys(spark: SparkSession) -> None:
    if spark.conf.get(DUPLICATE_KEYS, "false") != "true":
        spark.conf.set(DUPLICATE_KEYS, "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder on this machine.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_DIR} must name a shared folder on a cluster")
    return _local_dir(spark.sparkContext.applicationId)


@cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"sluiceway-{application}-")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    paths = _temporary.get()
    if paths is not None:
        paths.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Fixes values that depend on the physical layout (such as running row ids) and
    cuts the lineage; unlike executor-local storage it survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what :func:`stored` wrote meanwhile in this thread.

    Results that read such tables must be written or collected inside.
    """
    paths: list[str] = []
    token = _temporary.set(paths)
    try:
        yield
    finally:
        _temporary.reset(token)
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(
                target, True
            )
