"""Tables of an iteration, cut from the plan that made them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names; only local sessions may leave that unnamed."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return f"{context.getCheckpointDir()}/round-{uuid.uuid4().hex}"


def kept(df: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """df, written once to a folder of ``scratch``, so that a lost executor costs one round.

    ``done``, a table made here that is not needed any more, is deleted.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    context = spark.sparkContext
    df.write.parquet(path)
    for old in {f.rpartition("/")[0] for f in (done.inputFiles() if done is not None else [])}:
        if "/round-" in old:
            place = context._jvm.org.apache.hadoop.fs.Path(old)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    return spark.read.schema(df.schema).parquet(path)
