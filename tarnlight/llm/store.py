"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and
Spark runs in this process (tests, a local shell) a folder is made and set, and
removed when the process ends; on a cluster it must be set.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tarnlight-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows of what is run meanwhile go to Python workers in batches of BATCH_ROWS at most, for they may hold long texts."""
    kept = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(kept), BATCH_ROWS) if int(kept) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, kept)


class Workspace:
    """Tables of one operator call, under one folder of the shared directory.

    A saved table cuts lineage: a lost executor makes Spark reread the table's
    files instead of running the whole job again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(self.path(label))
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def settle(self) -> None:
        """Lets Spark delete the shuffle files of plans that are done: it does so once their objects are collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, label: str) -> None:
        """Frees the disk of a table that no later plan reads."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path(label))
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
