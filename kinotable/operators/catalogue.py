"""A scene's objects and their animation channels.

objects: (name, type, parent, ...); keyframes: (object, data_path, array_index, frame, value, interpolation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinotable.operators.selection import ordered
from kinotable.operators.timeline import on_windows
from kinotable.plans.keys import even_windows

#: Where an object that is never on stands in the order (a fixed value).
NEVER = 1_000_000


def key_counts(keyframes: DataFrame, keys: list[str], path: str = "data_path") -> DataFrame:
    """(keys, paths): a map from each channel to its number of keys."""
    each = keyframes.groupBy(*keys, path).agg(F.count(F.lit(1)).alias("__n"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(path, "__n")))).alias("paths"))


def modes(keyframes: DataFrame, keys: list[str], mode: str = "interpolation") -> DataFrame:
    """(keys, modes): the distinct modes of each channel, in order."""
    return keyframes.select(*keys, mode).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(mode)).alias("modes"))


def is_candidate(kind: Column, paths: Column, path: str = "scale", mesh: str = "MESH") -> Column:
    """Whether an object is a mesh with a channel of that name."""
    return F.coalesce((kind == mesh) & F.map_contains_key(paths, F.lit(path)), F.lit(False))


def scene_scale(objects: DataFrame, radius: Column, kind: Column, mesh: str = "MESH") -> DataFrame:
    """(scale): the greatest radius of a mesh, 0 without one."""
    return objects.agg(F.coalesce(F.max(F.when(kind == mesh, radius)), F.lit(0.0)).alias("scale"))


def first_listed(objects: DataFrame, kind: Column, paths: Column, name: Column, first: int | None = None, mesh: str = "MESH") -> DataFrame:
    """objects in catalogue order: meshes first, then by most channels, then by name."""
    return ordered(objects, kind != mesh, F.desc(F.coalesce(F.size(paths), F.lit(0))), name, first=first)


def retime_plan(samples: DataFrame, group: list[str], name: str, frame: str, on: Column, f0: int, f1: int) -> DataFrame:
    """(group, name, first_on, start, stop): each object's window of the frames f0..f1, in order of its first ON frame.

    Objects that are never on come last; nothing is changed, so the plan can be looked at first.
    """
    first = on_windows(samples, [*group, name], frame, on).drop("last_on")
    placed = first.withColumn("__order", F.coalesce("first_on", F.lit(NEVER)))
    return even_windows(placed, group, ["__order", name], f0, f1).drop("__order")
