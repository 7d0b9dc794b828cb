"""Planning time lines: even windows and regenerated keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def even_windows(objects: DataFrame, keys: list[str], order: list[str], f0: int, f1: int) -> DataFrame:
    """objects with ``start`` and ``stop``: the frames f0..f1 of each group, split evenly in order.

    Bounds are rounded half to even; with more objects than frames some windows are empty (stop < start).
    """
    group = Window.partitionBy(*keys)
    span = F.lit(float(f1 - f0 + 1)) / F.count(F.lit(1)).over(group)
    bound = lambda i: F.bround(F.lit(float(f0)) + i * span).cast("int")
    placed = objects.withColumn("__i", F.row_number().over(group.orderBy(*order)) - 1)
    return placed.withColumn("start", bound(F.col("__i"))).withColumn("stop", F.least(bound(F.col("__i") + 1) - 1, F.lit(f1))).drop("__i")


def _strongest(blocks: DataFrame, ends: DataFrame, keys: list[str], wanted: list) -> DataFrame:
    """(keys, frame, value) of the candidate keys; where several fall on a frame the strongest stays."""
    near = blocks.select(*keys, F.explode(F.array(*wanted)).alias("k"))
    far = ends.select(*keys, "k")
    found = near.union(far).filter("k.frame is not null").select(*keys, "k.frame", "k.value", "k.strength")
    return found.groupBy(*keys, "frame").agg(F.max_by("value", "strength").alias("value"))


def _key(frame, value: float, strength: int):
    return F.struct(frame.cast("int").alias("frame"), F.lit(value).alias("value"), F.lit(strength).alias("strength"))


def regenerated_keys(blocks: DataFrame, keys: list[str], f0: int, f1: int, on: float = 1.0, off: float = 0.0) -> DataFrame:
    """(keys, frame, value): on at both ends of each block (start, stop), off one frame outside and at f0 and f1.

    Keys outside f0..f1 are left out but for those of the blocks themselves; on wins over off.
    """
    inside = lambda f: F.when(f.between(f0, f1), f)
    a, b = F.col("start"), F.col("stop")
    ends = blocks.select(*keys).distinct().select(*keys, F.explode(F.array(_key(F.lit(f0), off, 0), _key(F.lit(f1), off, 0))).alias("k"))
    return _strongest(blocks, ends, keys, [_key(a, on, 1), _key(b, on, 1), _key(inside(a - 1), off, 0), _key(inside(b + 1), off, 0)])


def hide_keys(blocks: DataFrame, keys: list[str], f0: int, f1: int) -> DataFrame:
    """(keys, frame, hidden): shown from each start on, hidden after each stop, and hidden at f0 unless shown there.

    Where a block starts in the frame after another one's stop, the later block's key stays.
    """
    a, b = F.col("start"), F.col("stop")
    ends = blocks.select(*keys).distinct().select(*keys, _key(F.lit(f0), 1.0, 0).alias("k"))
    found = _strongest(blocks, ends, keys, [_key(a, 0.0, 2), _key(F.when(b + 1 <= f1, b + 1), 1.0, 1)])
    return found.select(*keys, "frame", (F.col("value") == 1.0).alias("hidden"))
