"""Layers as a stream: each new file in a folder is parsed and checked once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinotable.operators.rules import layer_checks, verdict


def stream_layers(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """(path, text) of each new file, at most ``files`` in a batch."""
    return spark.readStream.schema("value string").option("wholetext", True).option("maxFilesPerTrigger", files).format("text").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the verdict on each new layer to Parquet files in ``out``; ends when all present files are done.

    A batch that is run again after a loss writes the same folder again.
    """

    def each(batch: DataFrame, number: int) -> None:
        verdict(layer_checks(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream_layers(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
