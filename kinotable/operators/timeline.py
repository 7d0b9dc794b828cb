"""Keyed samples on a time line: interpolation, islands, changes, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evaluated(samples: DataFrame, frames: DataFrame, keys: list[str], frame: str, value: str) -> DataFrame:
    """(keys, frame, value) at each frame of each key, piecewise linear.

    Before the first and after the last sample the value is held.  Samples and
    frames of a key are walked together once; there is no range join.
    """
    order = Window.partitionBy(*keys).orderBy("__f", "__asked")
    known = F.when(F.col("__asked") == 0, F.struct("__f", "__v"))
    both = samples.select(*keys, F.col(frame).alias("__f"), F.col(value).alias("__v"), F.lit(0).alias("__asked")).unionByName(frames.select(*keys, F.col(frame).alias("__f"), F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__asked")))
    before = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(known, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    near = both.withColumn("__a", before).withColumn("__b", after).filter("__asked = 1")
    a, b = F.col("__a"), F.col("__b")
    out = F.when(a.isNull(), b["__v"]).when(b.isNull() | (a["__f"] == F.col("__f")), a["__v"]).otherwise(a["__v"] + (b["__v"] - a["__v"]) * (F.col("__f") - a["__f"]) / (b["__f"] - a["__f"]))
    return near.select(*keys, F.col("__f").alias(frame), out.alias(value))


def switched(samples: DataFrame, keys: list[str], value: Column, share: float = 0.5, absolute: bool = False) -> Column:
    """Whether a value is above the share of its key's greatest value, or above the share itself."""
    return value > (F.lit(share) if absolute else F.max(value).over(Window.partitionBy(*keys)) * share)


def islands(df: DataFrame, keys: list[str], order: list[str], state: Column, aggregates: list[Column]) -> DataFrame:
    """One row for each run of neighbouring rows whose state holds."""
    marked = df.withColumn("__on", state)
    ranks = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - F.row_number().over(Window.partitionBy(*keys, "__on").orderBy(*order))
    return marked.withColumn("__run", ranks).filter("__on").groupBy(*keys, "__run").agg(*aggregates).drop("__run")


def frame_islands(df: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """(keys, start, stop) of the runs of whole frames without a gap, in rows that are on."""
    place = F.col(frame) - F.row_number().over(Window.partitionBy(*keys).orderBy(frame))
    return df.select(*keys, frame).distinct().withColumn("__run", place).groupBy(*keys, "__run").agg(F.min(frame).alias("start"), F.max(frame).alias("stop")).drop("__run")


def changes(df: DataFrame, keys: list[str], order: list[str], state: Column) -> DataFrame:
    """Rows whose state differs from that of the row before, the first of each key as well."""
    before = F.lag("__state").over(Window.partitionBy(*keys).orderBy(*order))
    marked = df.withColumn("__state", state).withColumn("__before", before)
    return marked.filter("__before is null or __before <> __state").withColumnRenamed("__state", "state").drop("__before")


def on_windows(df: DataFrame, keys: list[str], frame: str, on: Column) -> DataFrame:
    """(keys, first_on, last_on); null where a key is never on."""
    return df.groupBy(*keys).agg(F.min(F.when(on, F.col(frame))).alias("first_on"), F.max(F.when(on, F.col(frame))).alias("last_on"))


def slow_transitions(df: DataFrame, keys: list[str], frame: str, value: str, level: float = 0.5, step: float = 1.0) -> DataFrame:
    """Neighbouring samples on both sides of the level that are not one step apart."""
    order = Window.partitionBy(*keys).orderBy(frame)
    pairs = df.withColumn("next_frame", F.lead(frame).over(order)).withColumn("next_value", F.lead(value).over(order))
    crossed = (F.col(value) > level) != (F.col("next_value") > level)
    return pairs.filter(crossed & (F.abs(F.col("next_frame") - F.col(frame) - step) > 1e-9)).select(*keys, frame, "next_frame", value, "next_value")


def coverage(df: DataFrame, spine: DataFrame, frame: str, on: Column, expected: int = 1) -> DataFrame:
    """(frame, n) of the frames of the spine at which not ``expected`` rows are on, none included."""
    counted = df.filter(on).groupBy(frame).agg(F.count(F.lit(1)).alias("n"))
    return spine.select(frame).distinct().join(counted, frame, "left").select(frame, F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") != expected)
