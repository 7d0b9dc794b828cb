"""Geometry of keyed points; a point is an array of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kinotable.functions.columns import add, affine, midpoint, norm, scaled, subtract
from kinotable.operators.curves import evaluated_points, evaluated_rotations
from kinotable.operators.hierarchy import composed
from kinotable.operators.timeline import evaluated
from kinotable.plans.rounds import kept


def _by_axis(points: DataFrame, keys: list[str], point: Column) -> DataFrame:
    return points.select(*keys, F.posexplode(F.transform(point, lambda x: x.cast("double"))).alias("axis", "x"))


def _gathered(rows: DataFrame, keys: list[str], *names: str) -> DataFrame:
    """A row for each key with an array over the axes for each name."""
    held = F.array_sort(F.collect_list(F.struct("axis", *names)))
    return rows.groupBy(*keys).agg(held.alias("held")).select(*keys, *[F.transform("held", lambda s: s[n]).alias(n) for n in names])


def centroids(points: DataFrame, keys: list[str], point: Column) -> DataFrame:
    """(keys, centroid): the mean of each axis."""
    means = _by_axis(points, keys, point).groupBy(*keys, "axis").agg(F.avg("x").alias("centroid"))
    return _gathered(means, keys, "centroid")


def radii(points: DataFrame, keys: list[str], point: Column) -> DataFrame:
    """(keys, centroid, radius): the greatest distance of a point to the centroid."""
    centre = centroids(points, keys, point)
    joined = points.select(*keys, point.alias("__p")).join(centre, keys)
    far = joined.groupBy(*keys).agg(F.max(norm(subtract(F.transform("__p", lambda x: x.cast("double")), F.col("centroid")))).alias("radius"))
    return centre.join(far, keys)


def bounds(points: DataFrame, keys: list[str], point: Column, matrix: Column | None = None) -> DataFrame:
    """(keys, lo, hi): the axis-aligned box, of transformed points if a matrix is given."""
    placed = point if matrix is None else affine(matrix, point)
    boxes = _by_axis(points, keys, placed).groupBy(*keys, "axis").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return _gathered(boxes, keys, "lo", "hi")


def united(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The box around the boxes of each key; boxes that are null are left out."""
    ends = boxes.filter("lo is not null").select(*keys, F.posexplode(F.arrays_zip("lo", "hi")).alias("axis", "s"))
    rows = ends.groupBy(*keys, "axis").agg(F.min("s.lo").alias("lo"), F.max("s.hi").alias("hi"))
    return _gathered(rows, keys, "lo", "hi")


#: Parts into which each of the first three axes is cut at most, and points of a block.
CELLS, BLOCK = 8, 4096
#: Rows of a block that are compared with another block at once.
_TILE = 512


def _widest(table: pa.Table) -> pa.Table:
    """One row with the greatest distance between points of side 0 and of side 1, or among those of side 0 if there are no others."""
    side, held = table["__side"].to_numpy(), table["__p"].combine_chunks()
    points = held.flatten().to_numpy().reshape(len(side), -1) if len(held.flatten()) else np.zeros((len(side), 0))
    points = points - points.mean(axis=0)  # so that little is lost where squares are subtracted
    a, b = points[side == 0], points[side == 1]
    b = b if len(b) else a
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    # squared distances are one product of matrices; pairs that its rounding can't tell from the widest are measured one by one
    left, right = np.column_stack([-2 * a, aa, np.ones(len(a))]), np.column_stack([b, np.ones(len(b)), bb]).T.copy()
    loss = 1e-14 * (a.shape[1] + 4) * (aa.max() + bb.max())
    best = 0.0
    for start in range(0, len(a), _TILE):
        squares = left[start : start + _TILE] @ right
        top = max(squares.max(), best)
        rows = np.flatnonzero(squares.max(axis=1) >= top - loss)
        for row in rows:
            near = np.flatnonzero(squares[row] >= top - loss)
            best = max(best, ((b[near] - a[start + row]) ** 2).sum(axis=1).max())
    first = table.slice(0, 1).drop_columns(["__one", "__other", "__side", "__p"])
    return first.append_column("diameter", pa.array([float(np.sqrt(best))]))


def diameters(points: DataFrame, keys: list[str], point: Column, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """(keys, diameter): the greatest distance between two distinct points; exact.

    With distances r to the centroid, and a pair at distance D known (the point
    farthest from the centroid and the one farthest from that), only points
    with r >= D - max r can be in a wider pair.  These are cut into cells, and
    cells into blocks; points are compared only where the boxes of two blocks
    allow a wider pair.  Each pair of blocks is work of its own, and a product
    of matrices.  In many dimensions boxes allow most pairs, so work stays
    quadratic there, with few operations a pair; in space few are left.
    """
    unique = points.select(*keys, F.transform(point, lambda x: x.cast("double")).alias("__p")).distinct()
    ranged = kept(unique.join(centroids(unique, keys, F.col("__p")), keys).withColumn("__r", norm(subtract(F.col("__p"), F.col("centroid")))))
    most = ranged.groupBy(*keys).agg(F.max_by("__p", F.struct("__r", "__p")).alias("__far"), F.max("__r").alias("__most"))
    away = norm(subtract(F.col("__p"), F.col("__far")))
    known = kept(ranged.join(most, keys).groupBy(*keys).agg(F.max(away).alias("__wide"), F.first("__most").alias("__most")))
    left = ranged.join(known, keys).filter(F.col("__r") + F.col("__most") >= F.col("__wide") - 1e-9)
    cut = F.greatest(F.lit(1), F.least(F.lit(cells), F.floor(F.cbrt(F.count(F.lit(1)) / block)))).alias("__cut")
    width = F.greatest("__most", F.lit(1e-300)) * 2 / F.col("__cut")
    part = lambda i: F.greatest(F.lit(0), F.least(F.col("__cut") - 1, F.floor((F.col("__p")[i] - F.col("centroid")[i] + F.col("__most")) / width))).cast("int")
    some = F.transform(F.sequence(F.lit(0), F.least(F.size("__p"), F.lit(3)) - 1), lambda i: part(i))
    cell = F.aggregate(F.when(F.size("__p") > 0, some).otherwise(F.array().cast("array<int>")), F.lit(0).cast("long"), lambda s, x: s * cells + x)
    placed = left.join(left.groupBy(*keys).agg(cut), keys).select(*keys, "__p", cell.alias("__cell"))
    pieces = placed.groupBy(*keys, "__cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("__pieces"))
    piece = F.pmod(F.xxhash64("__p"), F.col("__pieces"))
    blocks = kept(placed.join(pieces, [*keys, "__cell"]).select(*keys, "__p", F.struct("__cell", piece.alias("__piece")).alias("__block")))
    axes = blocks.select(*keys, "__block", F.posexplode("__p").alias("axis", "x")).groupBy(*keys, "__block", "axis").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    boxes = _gathered(axes, [*keys, "__block"], "lo", "hi")
    one, other = (boxes.select(*keys, F.col("__block").alias(name), F.col("lo").alias(f"lo{n}"), F.col("hi").alias(f"hi{n}")) for n, name in enumerate(("__one", "__other")))
    apart = lambda lo, hi: F.zip_with(lo, hi, lambda x, y: F.abs(y - x))
    reach = norm(F.zip_with(apart("lo0", "hi1"), apart("lo1", "hi0"), lambda x, y: F.greatest(x, y)))
    pairs = kept(one.join(other, keys).filter("__one <= __other").join(known, keys).filter(reach >= F.col("__wide") - 1e-9).select(*keys, "__one", "__other"))
    # a block that meets itself comes once
    sides = F.when(F.col("__one") == F.col("__other"), F.array("__one")).otherwise(F.array("__one", "__other"))
    asked = pairs.select(*keys, "__one", "__other", F.posexplode(sides).alias("__side", "__block"))
    tasks = max(1, min(pairs.count(), 4096))
    met = blocks.repartition(tasks, "__p").join(asked, [*keys, "__block"]).select(*keys, "__one", "__other", "__side", "__p")
    each = met.repartition(tasks, *keys, "__one", "__other").groupBy(*keys, "__one", "__other")
    named = [f for f in blocks.schema.fields if f.name in keys]
    wide = each.applyInArrow(_widest, StructType([*named, StructField("diameter", DoubleType())]))
    found = wide.groupBy(*keys).agg(F.max("diameter").alias("diameter"))
    # a key with one point has no pair of distinct ones; its distance is 0
    return known.select(*keys, "__wide").join(found, keys, "left").select(*keys, F.greatest("__wide", F.coalesce("diameter", F.lit(0.0))).alias("diameter"))


def boxes_at(boxes: DataFrame, moves: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, lo, hi) of boxes (keys, lo, hi) that move along their first axis, second, ... at each frame.

    moves: (keys, axis, frame, value) samples of a translation, interpolated; frames: (keys, frame).
    Boxes without moves stay where they are.
    """
    axes = moves.select(*keys, "axis").distinct().join(frames, keys)
    shifts = evaluated(moves, axes, [*keys, "axis"], "frame", "value").groupBy(*keys, "frame").agg(F.map_from_entries(F.collect_list(F.struct("axis", "value"))).alias("shift"))
    placed = frames.join(boxes, keys).join(shifts, [*keys, "frame"], "left")
    by = lambda c: F.transform(c, lambda x, i: x + F.coalesce(F.try_element_at("shift", i), F.lit(0.0)))
    return placed.select(*keys, "frame", by("lo").alias("lo"), by("hi").alias("hi"))


def _corners(lo: Column, hi: Column) -> Column:
    return F.array(*[F.array(*[(hi if i >> k & 1 else lo)[k] for k in range(3)]) for i in range(8)])


def posed_boxes(boxes: DataFrame, frames: DataFrame, keys: list[str], location: DataFrame | None = None, rotation: DataFrame | None = None, scale: DataFrame | None = None) -> DataFrame:
    """(keys, frame, lo, hi): the box around each box (keys, lo, hi) at each frame (keys, frame), as its channels pose it.

    Channels are samples (keys, frame, value): points, quaternions, factors of
    each axis.  They are sampled apart, composed to one matrix, and all eight
    corners are moved by it.  A key without samples of a channel is not moved,
    turned or scaled; a box that is null stays null.
    """
    posed = frames.select(*keys, "frame").withColumn("frame", F.col("frame").cast("double")).join(boxes.select(*keys, "lo", "hi"), keys)
    for name, samples, at in (("location", location, evaluated_points), ("rotation", rotation, evaluated_rotations), ("scale", scale, evaluated_points)):
        rest = F.array(*map(F.lit, {"location": (0.0, 0.0, 0.0), "rotation": (1.0, 0.0, 0.0, 0.0), "scale": (1.0, 1.0, 1.0)}[name]))
        if samples is None:
            posed = posed.withColumn(name, rest)
            continue
        found = at(samples, frames, keys).withColumnRenamed("value", name)
        posed = posed.join(found.dropDuplicates([*keys, "frame"]), [*keys, "frame"], "left").withColumn(name, F.coalesce(name, rest))
    placed = posed.withColumn("matrix", composed(F.col("location"), F.col("rotation"), F.col("scale"))).withColumn("points", F.transform(_corners(F.col("lo"), F.col("hi")), lambda p: affine(F.col("matrix"), p)))
    end = lambda pick: F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.array(*[pick(F.transform("points", lambda p: p[k])) for k in range(3)]))
    return placed.select(*keys, "frame", end(F.array_min).alias("lo"), end(F.array_max).alias("hi"))


def worst_frames(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, away): when the centre of the box (keys, frame, lo, hi) is farthest from the origin, the first of equals; null boxes don't count."""
    far = boxes.filter("lo is not null").select(*keys, "frame", norm(midpoint(F.col("lo"), F.col("hi"))).alias("away"))
    return far.groupBy(*keys).agg(F.max_by(F.struct("frame", "away"), F.struct("away", -F.col("frame"))).alias("w")).select(*keys, "w.frame", "w.away")


def recentre_delta(scene_lo: Column, scene_hi: Column, subject_lo: Column, subject_hi: Column, mode: str = "scene") -> Column:
    """The move that puts the centre of the scene's box, or of the subject's, at the origin."""
    if mode not in ("scene", "subject"):
        raise ValueError(f"no such mode: {mode}")
    return scaled(midpoint(scene_lo, scene_hi) if mode == "scene" else midpoint(subject_lo, subject_hi), -1.0)


def moved_keys(keyframes: DataFrame, roots: DataFrame, delta: Column) -> DataFrame:
    """keyframes (object, data_path, array_index, frame, value) with the location keys of ``roots`` (object) moved by the delta."""
    mine = keyframes.join(roots.select("object", F.lit(True).alias("__root")).distinct(), "object", "left")
    moves = F.col("__root").isNotNull() & (F.col("data_path") == "location")
    return mine.withColumn("value", F.when(moves, F.col("value") + delta[F.col("array_index")]).otherwise(F.col("value"))).drop("__root").select(*keyframes.columns)


def baked(points: DataFrame, point: Column, matrix: Column, on_scale: Column) -> DataFrame:
    """points with ``baked``: each scaled by its object's ON scale (1 where that is null or zero) and turned by its matrix."""
    return points.withColumn("baked", affine(matrix, scaled(F.transform(point, lambda x: x.cast("double")), F.coalesce(F.nullif(on_scale, F.lit(0.0)), F.lit(1.0)))))


def recentred(objects: DataFrame, centre: Column) -> DataFrame:
    """objects whose roots (no parent) are moved by minus the centre; children follow their parents."""
    return objects.withColumn("loc", F.when(F.col("parent").isNull(), subtract(F.col("loc"), centre)).otherwise(F.col("loc")))


def origin_to_centroid(vertices: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices taken relative to their object's centroid, and objects moved there instead."""
    centre = centroids(vertices, ["object"], F.array("x", "y", "z"))
    moved = vertices.join(centre, "object").select(*[c for c in vertices.columns if c not in ("x", "y", "z")], *[(F.col(c) - F.col("centroid")[i]).alias(c) for i, c in enumerate(("x", "y", "z"))])
    placed = objects.join(centre.withColumnRenamed("object", "name"), "name", "left")
    return moved, placed.withColumn("loc", F.when(F.col("centroid").isNotNull(), add(F.col("loc"), F.col("centroid"))).otherwise(F.col("loc"))).drop("centroid")
