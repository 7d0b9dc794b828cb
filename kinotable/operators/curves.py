"""Keyed curves at given frames: by interpolation mode, of points, and of rotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Halvings by which a cubic's time is found; more don't change a double.
HALVINGS = 54


def _between(samples: DataFrame, frames: DataFrame, keys: list[str], frame: str, names: list[str]) -> DataFrame:
    """(keys, f, a, b): for each frame the sample at or before it and the one after it; samples and frames are walked once."""
    known = samples.select(*keys, F.col(frame).cast("double").alias("f"), F.struct(F.col(frame).cast("double").alias("f"), *names).alias("s"), F.lit(0).alias("asked"))
    kind = known.schema["s"].dataType
    both = known.unionByName(frames.select(*keys, F.col(frame).cast("double").alias("f"), F.lit(None).cast(kind).alias("s"), F.lit(1).alias("asked")))
    order = Window.partitionBy(*keys).orderBy("f", "asked")
    before = F.last("s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("s", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return both.withColumn("a", before).withColumn("b", after).filter("asked = 1").drop("s", "asked")


def _held(inside: Column, value: str) -> Column:
    """inside between two samples; the value of the only one, or of the one at the frame itself, elsewhere."""
    a, b = F.col("a"), F.col("b")
    return F.when(a.isNull(), b[value]).when(b.isNull() | (a["f"] == F.col("f")), a[value]).otherwise(inside)


def _share() -> Column:
    return (F.col("f") - F.col("a.f")) / (F.col("b.f") - F.col("a.f"))


def _cubic(p: list[Column], t: Column) -> Column:
    u = F.lit(1.0) - t
    return u * u * u * p[0] + 3.0 * u * u * t * p[1] + 3.0 * u * t * t * p[2] + t * t * t * p[3]


def _bezier(value: str, right: str, left: str) -> Column:
    """A cubic of a sample, its right handle, the next one's left handle and the next one, at the time t whose frame is asked for."""
    a, b = F.col("a"), F.col("b")
    third = lambda x, k: a[x] + (b[x] - a[x]) * k / 3.0
    xs = [a["f"], F.coalesce(a[right]["f"], third("f", 1)), F.coalesce(b[left]["f"], third("f", 2)), b["f"]]
    ys = [a[value], F.coalesce(a[right]["v"], third(value, 1)), F.coalesce(b[left]["v"], third(value, 2)), b[value]]
    points = F.array(F.struct(*[x.alias(f"x{i}") for i, x in enumerate(xs)], *[y.alias(f"y{i}") for i, y in enumerate(ys)], F.col("f").alias("at")))

    def solved(p: Column) -> Column:
        x = [p[f"x{i}"] for i in range(4)]

        def halved(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            early = _cubic(x, mid) < p["at"]
            return F.struct(F.when(early, mid).otherwise(s["lo"]).alias("lo"), F.when(early, s["hi"]).otherwise(mid).alias("hi"))

        ends = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), ends, halved, lambda s: _cubic([p[f"y{i}"] for i in range(4)], (s["lo"] + s["hi"]) / 2))

    return F.transform(points, solved)[0]


def evaluated_by_mode(samples: DataFrame, frames: DataFrame, keys: list[str], frame: str, value: str, mode: str, right: str = "right", left: str = "left") -> DataFrame:
    """(keys, frame, value) at each frame of each key; what lies after a sample goes by that sample's mode.

    CONSTANT holds the value, LINEAR goes straight, BEZIER is a cubic whose
    time equation is solved by halving.  ``right`` and ``left`` are columns of
    handles (f, v) after and before a sample; null handles lie on the straight
    line, a third of the way.  Another mode, or none, is an error.  Handles are
    taken as they are: a host that shortens handles which cross must have done so.
    Before the first and after the last sample the value is held; of samples
    at one frame the caller keeps one.
    """
    handle = "struct<f:double,v:double>"
    given = samples.withColumns({n: F.col(n).cast(handle) if n in samples.columns else F.lit(None).cast(handle) for n in (right, left)}).withColumn(value, F.col(value).cast("double"))
    near = _between(given, frames, keys, frame, [value, mode, right, left])
    kind, straight = F.col(f"a.{mode}"), F.col(f"a.{value}") + (F.col(f"b.{value}") - F.col(f"a.{value}")) * _share()
    unknown = F.raise_error(F.concat(F.lit("no such mode: "), F.coalesce(kind, F.lit("null")))).cast("double")
    inside = F.when(kind == "CONSTANT", F.col(f"a.{value}")).when(kind == "LINEAR", straight).when(kind == "BEZIER", _bezier(value, right, left)).otherwise(unknown)
    return near.select(*keys, F.col("f").alias(frame), _held(inside, value).alias(value))


def evaluated_points(samples: DataFrame, frames: DataFrame, keys: list[str], frame: str = "frame", value: str = "value") -> DataFrame:
    """(keys, frame, value) of arrays of numbers, each going straight from sample to sample."""
    near = _between(samples.withColumn(value, F.col(value).cast("array<double>")), frames, keys, frame, [value])
    between = F.zip_with(F.col(f"a.{value}"), F.col(f"b.{value}"), lambda x, y: x + (y - x) * _share())
    return near.select(*keys, F.col("f").alias(frame), _held(between, value).alias(value))


def _unit(q: Column) -> Column:
    size = F.sqrt(F.aggregate(q, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(q, lambda x: x / size)).otherwise(F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0))))


def evaluated_rotations(samples: DataFrame, frames: DataFrame, keys: list[str], frame: str = "frame", value: str = "value") -> DataFrame:
    """(keys, frame, value) of quaternions (w, x, y, z), turning evenly by the shorter way from sample to sample."""
    near = _between(samples.withColumn(value, _unit(F.col(value).cast("array<double>"))), frames, keys, frame, [value])
    dot = F.aggregate(F.zip_with(F.col(f"a.{value}"), F.col(f"b.{value}"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    facts = F.array(F.struct(F.col(f"a.{value}").alias("p"), F.col(f"b.{value}").alias("q"), dot.alias("dot"), _share().alias("t")))

    def turned(x: Column) -> Column:
        sign, angle = F.when(x["dot"] < 0, -1.0).otherwise(1.0), F.acos(F.least(F.abs(x["dot"]), F.lit(1.0)))
        near_by = angle < 1e-6
        first = F.when(near_by, 1 - x["t"]).otherwise(F.sin((1 - x["t"]) * angle) / F.sin(angle))
        then = F.when(near_by, x["t"]).otherwise(F.sin(x["t"] * angle) / F.sin(angle)) * sign
        return _unit(F.zip_with(x["p"], x["q"], lambda a, b: a * first + b * then))

    return near.select(*keys, F.col("f").alias(frame), _held(F.transform(facts, turned)[0], value).alias(value))
