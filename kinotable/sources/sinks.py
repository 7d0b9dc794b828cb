"""Writing layers and reports as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_layers(layers: DataFrame, folder: str) -> None:
    """Each layer (path, text) as one file in a folder of its own, ``path=<its name>``.

    The writer ends a file with a line break, so a text without one at its end
    gains it; null texts are not written.
    """
    text = F.regexp_replace("text", r"\n\z", "")
    layers.filter("text is not null").select("path", text.alias("value")).write.partitionBy("path").mode("overwrite").text(folder)


def read_written(spark, folder: str) -> DataFrame:
    """(path, text) of the layers that ``write_layers`` wrote."""
    return spark.read.schema("value string, path string").option("wholetext", True).format("text").load(folder).select("path", F.col("value").alias("text"))


def report(checks: DataFrame) -> DataFrame:
    """(path, value): a line of text for each check row (path, check, ok, detail), and a last one for each path."""
    line = F.concat(F.when(F.col("ok"), "ok   ").otherwise("FAIL "), "check", F.when(F.coalesce(F.col("detail"), F.lit("")) == "", "").otherwise(F.concat(F.lit(": "), "detail")))
    rows = checks.groupBy("path").agg(F.array_sort(F.collect_list(line)).alias("held"), F.every("ok").alias("ok"))
    return rows.select("path", F.array_join(F.array_append("held", F.when(F.col("ok"), "passed").otherwise("failed")), "\n").alias("value"))


def write_report(checks: DataFrame, folder: str) -> None:
    """The report of each path as a text file in its own folder."""
    report(checks).write.partitionBy("path").mode("overwrite").text(folder)
