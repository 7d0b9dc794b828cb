"""Changes of verdicts: a stream that keeps each layer's last verdict and tells only when it turns.

An extension: the checks themselves keep nothing between runs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from kinotable.functions.columns import file_name

VERDICTS = "path string, ok boolean, problems array<string>, batch long"
FLIPS = "layer string, batch long, before boolean, ok boolean, problems array<string>"
#: The store that this kind of state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastVerdict(StatefulProcessor):
    """State of a layer: the batch it was last judged in, and how."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "batch long, ok boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batch, before = self.last.get() if self.last.exists() else (-1, None)
        for row in sorted(rows, key=lambda r: r.batch):
            if row.batch <= batch:  # a batch that was written again
                continue
            if row.ok != before:
                yield Row(layer=key[0], batch=row.batch, before=before, ok=row.ok, problems=row.problems)
            batch, before = row.batch, row.ok
            self.last.update((batch, before))

    def close(self) -> None:
        pass


def flips(verdicts: DataFrame) -> DataFrame:
    """(layer, batch, before, ok, problems) of a stream of verdicts (path, ok, problems, batch): the first verdict of each layer, and each that differs from the one before.

    A layer is known by its file name, so later deliveries may come in other
    folders.  State survives a restart from the query's checkpoint.
    """
    named = verdicts.withColumn("layer", file_name(F.col("path")))
    return named.groupBy("layer").transformWithState(statefulProcessor=LastVerdict(), outputStructType=FLIPS, outputMode="Append", timeMode="None")


def watch_flips(spark: SparkSession, verdicts: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the flips among verdicts that ``streaming.layers.watch`` wrote to ``verdicts`` to Parquet files in ``out``; ends when all present ones are done."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    told = spark.readStream.schema(VERDICTS).parquet(verdicts)
    return flips(told).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
