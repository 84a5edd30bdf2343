"""Where materialised intermediate tables and file round trips go."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_WAREHOUSE_DIR = "spark.sql.warehouse.dir"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir``, or the folder given to ``setCheckpointDir``; where
    neither is set, a folder below the warehouse, which every session has.
    """
    base = spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    return base or f"{spark.conf.get(_WAREHOUSE_DIR).rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`scratch_root`, removed when the session's JVM ends.

    Lazy results read it until then, so it cannot go earlier.
    """
    folder = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return f"{folder}/data"


def materialise(df: DataFrame, label: str, apart: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Every later reader sees the same rows, also after a lost executor, and
    what computed them does not run again. Rows that differ in ``apart`` lie in
    different folders: who filters on it reads no others.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write if apart is None else df.write.partitionBy(apart)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def drop_shuffles(spark: SparkSession) -> Iterator[None]:
    """Whatever is written inside drops its shuffle files once it is written.

    Else they stay until the driver's JVM happens to collect their handles. What was
    written is read in their place, so nothing needs them.
    """
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)
