"""Cutting a plan so that it is worked out once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes a query's shuffle files as soon as the query has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only in local mode, where the session names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


@contextmanager
def tidily(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and end in here leave no shuffle files behind."""
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def checkpointed(df: DataFrame, done: Iterable[DataFrame] = ()) -> DataFrame:
    """df as a Parquet table in the checkpoint folder; afterwards the tables ``done``, made here as well, are deleted.

    The shuffle files that made it go as soon as it is written: nothing that
    reads the table needs them, however many executors are lost.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/table-{uuid.uuid4().hex}"
    with tidily(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    for old in done:
        dropped(old)
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by ``checkpointed``; other frames are left alone."""
    if (path := _PLACES.pop(df, None)) is not None:
        context = df.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
