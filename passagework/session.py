"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "passagework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; callers pass cluster sizes through `conf`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _package_zip() -> str:
    root = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="passagework-")) / root.name
    return shutil.make_archive(str(base), "zip", root.parent, root.name)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, unless the session's applications already carry it.

    Same as starting with `--py-files`; a second call for a session does nothing.
    """
    archive = _package_zip()
    if not any(str(f).endswith(Path(archive).name) for f in spark.sparkContext.listFiles):
        spark.sparkContext.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: `spark.checkpoint.dir`.

    Without the setting a temporary folder is made, for a session on this machine only;
    on a cluster every executor would write to a folder of its own, so that fails.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir()


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="passagework-")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path for one written table below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Store `df` in the shared folder and go on from the stored copy.

    Used where a costly result feeds several consumers: it cuts the lineage,
    and a lost executor rereads files instead of recomputing the whole plan.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's setting by which a query's shuffle files are removed when it ends, not when the driver collects its garbage.
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files when they have ended."""
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVE_SHUFFLES)
        else:
            spark.conf.set(_REMOVE_SHUFFLES, before)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Repartition a plain file scan that has fewer partitions than the cluster has cores.

    For CPU-heavy row work on few or unsplittable files. A scan with enough
    partitions is returned as it is, so nothing is shuffled at scale.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)
