"""The folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Where checkpoints and tables between steps go: spark.checkpoint.dir, or what the context was given.

    Only where neither names one and master is this machine, as in tests, a temporary folder is made and set; on a cluster
    that is an error, since its machines share no such folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
            import tempfile

            named = tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(named)
    return (named or context.getCheckpointDir()).rstrip("/")


#: Whether a query's shuffle files go when it ends; else they stay until the driver collects its garbage.
SWEPT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files."""
    before = spark.conf.get(SWEPT)
    spark.conf.set(SWEPT, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEPT, before)
