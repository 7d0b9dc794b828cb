"""Grouping, ordering and set operations on names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_kind(df: DataFrame, kind: str, name: str, order: Column, first: int = 4) -> DataFrame:
    """(kind, n, names): how many, and the first names in the given order."""
    place = F.row_number().over(Window.partitionBy(kind).orderBy(order, name))
    few = df.withColumn("__place", place).filter(F.col("__place") <= first).groupBy(kind).agg(F.transform(F.array_sort(F.collect_list(F.struct("__place", F.col(name).alias("name")))), lambda s: s["name"]).alias("names"))
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).join(few, kind)


def common_prefix(df: DataFrame, text: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, prefix): the longest common prefix, which is that of the least and the greatest."""
    ends = df.groupBy(*(keys or [])).agg(F.min(text).alias("__lo"), F.max(text).alias("__hi"))
    size = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length("__lo"), F.lit(1))), lambda i: F.substring("__lo", F.lit(1), i) == F.substring("__hi", F.lit(1), i)))
    return ends.select(*(keys or []), F.substring("__lo", F.lit(1), F.when(F.length("__lo") == 0, 0).otherwise(size)).alias("prefix"))


def moving(df: DataFrame, keys: list[str], value: Column, digits: int | None = None) -> DataFrame:
    """(keys, n_values, lo, hi) of keys with more than one value, after rounding if digits are given."""
    seen = value if digits is None else F.transform(value, lambda x: F.bround(x, digits))
    held = df.select(*keys, seen.alias("__v")).groupBy(*keys)
    return held.agg(F.count_distinct("__v").alias("n_values"), F.min("__v").alias("lo"), F.max("__v").alias("hi")).filter("n_values > 1")


def common_divisor(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, divisor): the greatest common divisor of the positive whole values."""
    seen = df.select(*keys, value.cast("long").alias("__v")).filter("__v > 0").distinct()
    step = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("x"), b.alias("y")), lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(s["x"] % F.when(s["y"] == 0, F.lit(1).cast("long")).otherwise(s["y"])).alias("y")), lambda s: s["x"])
    fold = lambda held: F.aggregate(held, F.lit(0).cast("long"), lambda s, v: F.when(s == 0, v).otherwise(step(s, v)))
    # in two steps, so that no list holds all values of a key
    part = seen.groupBy(*keys, F.pmod(F.xxhash64("__v"), F.lit(64)).alias("__part")).agg(F.collect_list("__v").alias("__v")).select(*keys, fold(F.col("__v")).alias("__v"))
    return part.groupBy(*keys).agg(F.collect_list("__v").alias("__v")).select(*keys, fold(F.col("__v")).alias("divisor"))


def ordered(df: DataFrame, *order: Column, first: int | None = None) -> DataFrame:
    """df in the given order; only the first rows if a number is given."""
    placed = df.orderBy(*order)
    return placed if first is None else placed.limit(first)


def supported(options: Column, known: list[str]) -> tuple[Column, Column]:
    """The options (a map) that are known, and the names of the others in order."""
    return F.map_filter(options, lambda k, _: k.isin(known)), F.array_sort(F.array_except(F.map_keys(options), F.array(*map(F.lit, known))))


def quarter_points(t0: Column, t1: Column) -> Column:
    """Start, quarters and end without repetition, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.array(*[F.lit(k / 4) for k in range(5)]), lambda k: t0 + (t1 - t0) * k)))
