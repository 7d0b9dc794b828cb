"""Rewriting layers: text patches, and time samples frozen to static values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinotable.functions.columns import general, generals, magnitude
from kinotable.operators.timeline import changes, evaluated, switched
from kinotable.plans.rounds import kept
from kinotable.sources.layers import block_raw_samples, block_samples, blocks, last_of_each_frame, stage_meta
from kinotable.sources.structure import text_lines


def apply_patches(layers: DataFrame, patches: DataFrame) -> DataFrame:
    """(path, text) with each patch (path, start, stop, repl; offsets from 0) put in; overlapping patches raise an error."""
    one = F.array_sort(F.collect_list(F.struct("start", "stop", "repl")))
    each = patches.groupBy("path").agg(one.alias("p"))
    before = lambda i: F.when(i > 0, F.col("p")[F.greatest(i - 1, F.lit(0))]["stop"]).otherwise(F.lit(0))
    clash = F.exists(F.transform("p", lambda x, i: x["start"] < before(i)), lambda c: c)
    kept = F.transform("p", lambda x, i: F.concat(F.substring("text", (before(i) + 1).cast("int"), (x["start"] - before(i)).cast("int")), x["repl"]))
    rest = F.substring("text", (F.element_at("p", -1)["stop"] + 1).cast("int"), F.length("text"))
    done = F.when(clash, F.raise_error(F.concat(F.lit("overlapping patches in "), F.col("path")))).otherwise(F.concat(F.array_join(kept, ""), rest))
    return layers.join(each, "path", "left").select("path", F.when(F.col("p").isNull(), F.col("text")).otherwise(done).alias("text"))


#: Attributes that are frozen to one value, besides the scale.
OTHERS = r"xformOp:(?:translate|orient|transform|rotate\w*)"
_SCALE = "xformOp:scale"
_KEYS = ["path", "prim", "from_ln"]


def _blocks(layers: DataFrame, attributes: str) -> DataFrame:
    """The lines of all blocks of the attributes, found in one pass over the text and written once."""
    return kept(blocks(text_lines(layers), attributes).withColumnRenamed("start", "from_ln"))


def _placed(found: DataFrame) -> DataFrame:
    """(path, prim, from_ln, indent, decl, attr, start, stop) of closed blocks, with character offsets."""
    ends = F.min("at").alias("start"), F.max(F.col("at") + F.col("size")).alias("stop")
    return found.filter("closed").groupBy(*_KEYS, "indent", "decl", "attr").agg(*ends)


def _size(value: Column, component: str) -> Column:
    """What of a scale decides whether it is on: its greatest absolute component, or the first one as it is."""
    if component not in ("maxabs", "x"):
        raise ValueError(f"no such component: {component}")
    return magnitude(value) if component == "maxabs" else value[0]


def _scales(found: DataFrame, component: str = "maxabs") -> DataFrame:
    """(path, prim, from_ln, frame, ln, pos, value, mag) of scale samples, one for each frame."""
    each = block_samples(found.filter(F.col("attr") == _SCALE).withColumnRenamed("from_ln", "start")).withColumnRenamed("start", "from_ln")
    return last_of_each_frame(each.drop("attr"), _KEYS, ["ln", "pos"]).withColumn("mag", _size(F.col("value"), component))


def _seen(scaled: DataFrame, layers: DataFrame, share: float = 0.5, level: float | None = None) -> DataFrame:
    limit = F.col("most") * share if level is None else F.lit(level)
    stage = stage_meta(layers).select("path", F.col("t0").cast("int").alias("a"), F.col("t1").cast("int").alias("b"))
    most = scaled.groupBy(*_KEYS).agg(F.max("mag").alias("most"))
    asked = most.join(stage, "path").select(*_KEYS, F.explode(F.sequence("a", F.greatest("a", "b")).cast("array<double>")).alias("frame"))
    seen = evaluated(scaled, asked, _KEYS, "frame", "mag").join(most, _KEYS).withColumn("token", F.when(F.col("mag") > limit, "inherited").otherwise("invisible"))
    return changes(seen, _KEYS, ["frame"], F.col("token")).select(*_KEYS, F.col("frame").cast("int").alias("frame"), "token")


def visibility(layers: DataFrame, share: float = 0.5, component: str = "maxabs", level: float | None = None) -> DataFrame:
    """(path, prim, from_ln, frame, token): when each scaled prim is seen, as runs over the whole frames of the stage.

    A prim is seen where its interpolated scale is above the share of its
    greatest, or above ``level`` if that is given.  ``component`` is "maxabs",
    the greatest absolute component of a scale, or "x", the first one.  Where
    a frame has two samples, the last in the file counts.
    """
    return _seen(_scales(_blocks(layers, rf"\Q{_SCALE}\E"), component), layers, share, level)


def raw_visibility(samples: DataFrame, keys: list[str], frame: str, magnitude: Column, start: Column | None = None, share: float = 0.5) -> DataFrame:
    """(keys, frame, token) from the samples themselves, without interpolation: one row at each change.

    With ``start`` (a column of samples) a key whose first sample comes later is
    invisible from there on; without it the first sample decides what was before.
    """
    own = samples.select(*keys, F.col(frame).alias("frame"), magnitude.alias("__m"), (F.lit(None).cast("double") if start is None else start).alias("__start"))
    token = F.when(switched(own, keys, F.col("__m"), share), "inherited").otherwise("invisible")
    rows = own.withColumn("token", token).select(*keys, "frame", "token")
    early = own.groupBy(*keys).agg(F.min("frame").alias("__first"), F.min("__start").alias("frame")).filter("__first > frame").select(*keys, "frame", F.lit("invisible").alias("token"))
    return changes(rows.unionByName(early), keys, ["frame"], F.col("token")).select(*keys, "frame", "token")


def freeze_patches(layers: DataFrame, others: str = OTHERS, sampled: bool = False) -> DataFrame:
    """Patches that freeze scale samples to a static scale with visibility, and other samples to one value.

    With ``sampled`` a prim's visibility changes at its samples only, as
    ``raw_visibility`` tells; otherwise at whole frames, between samples as well.

    The scale is that of the first sample, in file order, above half of the
    greatest; a scale that is zero throughout stays as it is.  Other samples
    keep the value at the first frame in which the prim is seen, if there is a
    sample, else the earliest one.  Where a frame has two samples, the last in
    the file counts.
    """
    found = _blocks(layers, rf"\Q{_SCALE}\E|{others}")
    place, scaled = _placed(found), _scales(found)
    top = F.max("mag").over(Window.partitionBy(*_KEYS))
    full = scaled.withColumn("most", top).filter("mag > most * 0.5").groupBy(*_KEYS).agg(F.min_by("value", F.struct("ln", "pos")).alias("full"))
    if sampled:
        staged = scaled.join(stage_meta(layers).select("path", "t0"), "path")
        seen = raw_visibility(staged, _KEYS, "frame", F.col("mag"), F.col("t0"))
    else:
        seen = _seen(scaled, layers)
    seen = seen.withColumn("at", general(F.col("frame")) if sampled else F.col("frame").cast("string"))
    told = seen.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("frame", "token", "at"))).alias("vis"))
    told = kept(told.withColumn("first_on", F.array_min(F.transform(F.filter("vis", lambda v: v["token"] == "inherited"), lambda v: v["frame"]))))
    static = F.concat("indent", "decl", F.lit(" = ("), F.array_join(generals(F.col("full")), ", "), F.lit(")"))
    shown = F.concat_ws("\n", F.transform("vis", lambda v: F.concat("indent", F.lit("    "), v["at"], F.lit(': "'), v["token"], F.lit('",'))))
    text = F.concat_ws("\n", static, F.concat("indent", F.lit("token visibility.timeSamples = {")), shown, F.concat("indent", F.lit("}")))
    scales = place.filter(F.col("attr") == _SCALE).join(full, _KEYS).join(told, _KEYS).select("path", "start", "stop", text.alias("repl"))
    first = told.groupBy("path", "prim").agg(F.min("first_on").cast("double").alias("first_on"))
    raw = block_raw_samples(found.filter(F.col("attr") != _SCALE).withColumnRenamed("from_ln", "start")).withColumnRenamed("start", "from_ln")
    raw = last_of_each_frame(raw.select(*_KEYS, "ln", "frame", "raw"), _KEYS, ["ln"]).join(first, ["path", "prim"], "left")
    pick = raw.groupBy(*_KEYS).agg(F.coalesce(F.max(F.when(F.col("frame") == F.col("first_on"), F.col("raw"))), F.min_by("raw", "frame")).alias("raw"))
    still = place.filter(F.col("attr") != _SCALE).join(pick, _KEYS).select("path", "start", "stop", F.concat("indent", "decl", F.lit(" = "), "raw").alias("repl"))
    return scales.unionByName(still)


def injected(layers: DataFrame) -> DataFrame:
    """(path, text) with scale samples as a static scale and visibility at the samples; other samples stay."""
    return apply_patches(layers, freeze_patches(layers, "(?!)", sampled=True))


def overlaps(patches: DataFrame) -> DataFrame:
    """(path, start, stop, before): patches (path, start, stop) that begin before an earlier one has ended, at ``before``."""
    earlier = Window.partitionBy("path").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    return patches.select("path", "start", "stop", F.max("stop").over(earlier).alias("before")).filter("start < before")


def frozen(layers: DataFrame) -> DataFrame:
    """(path, text) with all time samples of transforms frozen."""
    return apply_patches(layers, freeze_patches(layers))
