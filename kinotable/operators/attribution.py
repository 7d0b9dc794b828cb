"""Nearest-preceding ("as-of") attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def preceding(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, default: Column | None = None) -> DataFrame:
    """df with the last non-null value at or before each row of its group."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last(value, ignorenulls=True).over(upto)
    return df.withColumn(name, found if default is None else F.coalesce(found, default))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, name: str, bucket: Column, tie: str | None = None) -> DataFrame:
    """left with the value of the latest right row at or before it (same keys).

    ``bucket`` is a column of time that grows with it, e.g. a day.  Rows are
    sorted inside a key's bucket only; one row for each bucket carries the last
    value on to the later ones, so a key that holds most rows is many tasks'
    work.  At equal times a right row counts as before; among right rows the
    greater value of ``tie`` is later.
    """
    order = F.col(tie) if tie else F.lit(0)
    rows = left.withColumn("__side", F.lit(1)).withColumn("__value", F.lit(None)).withColumn("__tie", F.lit(None))
    marks = right.select(*keys, time, F.lit(0).alias("__side"), F.col(value).alias("__value"), order.alias("__tie"))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("__bucket", bucket)
    latest = marks.withColumn("__bucket", bucket).groupBy(*keys, "__bucket").agg(F.max_by("__value", F.struct(time, "__tie")).alias("__last"))
    spine = both.select(*keys, "__bucket").distinct().join(latest, [*keys, "__bucket"], "left")
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = spine.select(*keys, "__bucket", before.alias("__carried"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(time, "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(name, F.last("__value", ignorenulls=True).over(inside)).filter("__side = 1")
    return found.join(carried, [*keys, "__bucket"], "left").withColumn(name, F.coalesce(name, "__carried")).select(*left.columns, name)
