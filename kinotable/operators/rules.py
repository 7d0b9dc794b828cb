"""Rules: measured numbers to verdicts, one row for each check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinotable.functions.columns import ratio
from kinotable.operators.selection import moving
from kinotable.operators.timeline import evaluated, on_windows, slow_transitions
from kinotable.sources.layers import attribute_counts, block_samples, blocks, last_of_each_frame, lines, prims, raw_samples, samples, stage_meta

#: Kinds of objects that must not be in an exported scene (fixed values).
LEAKED_KINDS = ("Camera", "DistantLight", "SphereLight", "RectLight", "DiskLight", "CylinderLight", "DomeLight")
#: Bytes of a package above which there is a warning (a fixed value).
SIZE_WARNING = 25 * 1048576
#: Channels that may move an object (fixed values).
MOVING_CHANNELS = ("location", "rotation_euler", "rotation_quaternion", "delta_location", "delta_rotation_euler")


def origin_verdict(distance: Column, radius: Column) -> Column:
    """How far a centroid lies from its origin, in radii: guilty from 2, caution from 0.5."""
    r = ratio(distance, radius)
    return F.when(r >= 2, "guilty").when(r >= 0.5, "caution").otherwise("ok")


def spread_verdict(travel: Column, radius: Column, scene: Column) -> Column:
    """spread: a radius above a tenth of the scene's; moving: travel above a fiftieth of it."""
    return F.when(radius > scene * 0.1, "spread").when(travel > scene * 0.02, "moving").otherwise("ok")


def worst_verdict(verdicts: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """(keys, verdict) of a scene from those of its objects: guilty if one is, else suspect if one is at the edge."""
    v = F.col(verdict)
    return verdicts.groupBy(*keys).agg(F.when(F.some(v == "guilty"), "guilty").when(F.some(v == "caution"), "suspect").otherwise("ok").alias("verdict"))


def forbidden_channel(path: Column) -> Column:
    """Whether a channel may move or turn an object."""
    return path.isin(*MOVING_CHANNELS)


def only_switches(paths: Column) -> Column:
    """Whether all channels of an array only scale or hide."""
    return F.forall(paths, lambda p: (p == "scale") | F.startswith(p, F.lit("hide_")))


def origin_fixed(distance: Column, radius: Column, paths: Column) -> Column:
    """After a fix: the centroid is within a hundredth of the radius of the origin, and only switches are left."""
    return (distance <= F.greatest(F.lit(1e-4), radius * 0.01)) & only_switches(paths)


def object_checks(samples: DataFrame, frames: DataFrame, keys: list[str], frame: str, value: str, level: float = 0.5) -> DataFrame:
    """(keys, crosses, sharp, first_on, last_on, ok) of each object: its values lie on both sides of the
    level, each crossing takes one frame, and it is on at some of its ``frames`` (interpolated)."""
    held = samples.groupBy(*keys).agg(((F.min(value) < level) & (F.max(value) > level)).alias("crosses"))
    slow = slow_transitions(samples, keys, frame, value, level).groupBy(*keys).agg(F.count(F.lit(1)).alias("slow"))
    on = on_windows(evaluated(samples, frames, keys, frame, value), keys, frame, F.col(value) > level)
    out = held.join(slow, keys, "left").join(on, keys, "left").withColumn("sharp", F.col("slow").isNull()).drop("slow")
    return out.select(*keys, "crosses", "sharp", "first_on", "last_on", (F.col("crosses") & F.col("sharp") & F.col("first_on").isNotNull()).alias("ok"))


def freeze_checks(layers: DataFrame, done: DataFrame) -> DataFrame:
    """Check rows (path, check, ok, detail) of frozen layers against what they were made of.

    No scale, matrix or translate samples may be left, and there must be a
    visibility block for each scale block that was frozen, no more.
    """
    names = ["xformOp:scale", "xformOp:transform", "xformOp:translate", "visibility"]
    short = dict(zip(names, ("scale", "matrix", "translate", "shown")))
    left = attribute_counts(done, names).withColumnsRenamed(short)
    jobs = attribute_counts(layers, names[:1]).withColumnRenamed(names[0], "jobs")
    both = left.join(jobs, "path", "left")
    return _rows(both, [*[(f"no {x} samples", F.col(x) == 0, F.col(x)) for x in ("scale", "matrix", "translate")], ("visibility of each", F.col("shown") == F.col("jobs"), F.col("shown"))])


def zero_frames(samples: DataFrame, keys: list[str], size: Column, first: int = 10) -> DataFrame:
    """(keys, n, frames): at how many samples, and at which first ones, the size is zero; samples without a frame come last."""
    zero = samples.filter(size < 1e-9).withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("frame"))))
    return zero.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("__place") <= first, F.col("frame")))).alias("frames"))


def pops(tps: Column) -> Column:
    """Whether one time code lasts a tenth of a second or less."""
    return F.coalesce(F.try_divide(F.lit(1.0), F.nullif(tps, F.lit(0.0))) <= 0.1, F.lit(False))


def pivot_verdict(distance: Column, half_diagonal: Column) -> Column:
    """Where a pivot lies: at the centre, less than a twentieth of the half diagonal away, or off."""
    return F.when(distance < 1e-3, "centred").when(ratio(distance, half_diagonal) < 0.05, F.when(half_diagonal > 1e-9, "near").otherwise("off")).otherwise("off")


def pivot_within(distance: Column, half_diagonal: Column) -> Column:
    """Whether a pivot is within tolerance: a thousandth, or a twentieth of the half diagonal."""
    return distance <= F.greatest(F.lit(1e-3), half_diagonal * 0.05)


def packaging(entries: DataFrame, unit: int = 64) -> DataFrame:
    """Check rows (path, check, ok, detail) of container entries (path, name, method, data_off, size, crc, crc_ok)."""
    each = entries.groupBy("path").agg(F.every(F.col("method") == 0).alias("stored"), F.every(F.pmod("data_off", F.lit(unit)) == 0).alias("aligned"), F.every("crc_ok").alias("intact"), F.sum("size").alias("size"))
    return _rows(each, [("stored", F.col("stored"), F.lit("")), ("aligned", F.col("aligned"), F.lit("")), ("intact", F.col("intact"), F.lit("")), ("size", F.lit(True), F.when(F.col("size") > SIZE_WARNING, "large").otherwise(""))])


def _rows(df: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    held = F.array(*[F.struct(F.lit(name).alias("check"), ok.alias("ok"), detail.cast("string").alias("detail")) for name, ok, detail in checks])
    return df.select("path", F.explode(held).alias("c")).select("path", "c.*")


def layer_coverage(layers: DataFrame, component: str = "x", level: float = 0.5, expected: int = 1, scene: Column | None = None) -> DataFrame:
    """(path, frame, n): whole frames of a stage at which not ``expected`` prims have an interpolated scale above the level.

    Layers for which ``scene``, a column of layers, agrees are one stage, named by it.
    """
    named = layers.withColumn("__scene", F.col("path") if scene is None else scene)
    scaled = last_of_each_frame(block_samples(blocks(lines(layers), r"\QxformOp:scale\E")), ["path", "prim", "start"], ["ln", "pos"])
    scaled = scaled.withColumn("size", F.col("value")[0] if component == "x" else F.array_max(F.transform("value", lambda x: F.abs(x))))
    stage = stage_meta(layers).join(named.select("path", "__scene"), "path")
    ends = stage.groupBy("__scene").agg(F.min(F.col("t0").cast("int")).alias("a"), F.max(F.col("t1").cast("int")).alias("b"))
    spine = ends.filter("b >= a").select("__scene", F.explode(F.sequence("a", "b").cast("array<double>")).alias("frame"))
    keys = ["__scene", "path", "prim", "start"]
    mine = scaled.join(named.select("path", "__scene"), "path")
    at = evaluated(mine, mine.select(*keys).distinct().join(spine, "__scene"), keys, "frame", "size")
    on = at.filter(F.col("size") > level).groupBy("__scene", "frame").agg(F.count(F.lit(1)).alias("n"))
    # stages without any scale samples are not judged
    told = spine.join(mine.select("__scene").distinct(), "__scene", "left_semi").join(on, ["__scene", "frame"], "left")
    return told.select(F.col("__scene").alias("path"), F.col("frame").cast("int").alias("frame"), F.coalesce("n", F.lit(0).cast("long")).alias("n")).filter(F.col("n") != expected)


def layer_checks(layers: DataFrame, component: str = "maxabs", digits: int | str | None = 6) -> DataFrame:
    """Check rows (path, check, ok, detail) of layers: no moving translate, no matrix samples, no zero scale, no cameras or lights, slow time codes.

    component: "x" looks at the first component of a scale, "maxabs" at all; digits: None compares
    values exactly, "raw" what is written of them.
    """
    numbered = lines(layers)
    if digits == "raw":
        values, value, digits = raw_samples(numbered, r"\QxformOp:translate\E"), F.col("raw"), None
    else:
        values, value = samples(numbered, "xformOp:translate"), F.col("value")
    moved = moving(values, ["path", "prim"], value, digits).groupBy("path").agg(F.count(F.lit(1)).alias("moving"))
    size = F.abs(F.col("value")[0]) if component == "x" else F.array_max(F.transform("value", lambda x: F.abs(x)))
    zero = samples(numbered, "xformOp:scale").filter(size < 1e-9).groupBy("path").agg(F.count(F.lit(1)).alias("zero"))
    leaked = prims(numbered, LEAKED_KINDS).groupBy("path").agg(F.count(F.lit(1)).alias("leaked"))
    counts = attribute_counts(layers, ["xformOp:transform", "visibility"]).withColumnsRenamed({"xformOp:transform": "matrix", "visibility": "shown"})
    all_ = reduce(lambda a, b: a.join(b, "path", "left"), [counts, moved, zero, leaked, stage_meta(layers).select("path", "tps", "fps")])
    n = lambda c: F.coalesce(c, F.lit(0))
    rate = F.coalesce(F.nullif("tps", F.lit(0.0)), F.nullif("fps", F.lit(0.0)), F.lit(0.0))
    return _rows(all_, [("no moving translate", n("moving") == 0, n("moving")), ("no matrix samples", F.col("matrix") == 0, F.col("matrix")), ("no zero scale", n("zero") == 0, n("zero")), ("no cameras or lights", n("leaked") == 0, n("leaked")), ("visibility", F.lit(True), F.when(F.col("shown") > 0, "").otherwise("none")), ("short time codes", pops(rate), rate)])


def verdict(checks: DataFrame) -> DataFrame:
    """(path, ok, problems): all checks together; problems are the failed ones by name."""
    return checks.groupBy("path").agg(F.every("ok").alias("ok"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("check")))).alias("problems"))
