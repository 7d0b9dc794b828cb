"""Scene layers as tables: text files to lines, prims, stage data and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinotable.functions.columns import NUMBER, extension, first_match
from kinotable.operators.attribution import preceding
from kinotable.sources.structure import DEFINITION, STAGE, enclosing, structured

#: Values that the layer format sets (fixed values): an asset between at signs, extensions of layers themselves.
ASSET = r"@([^@\n]+)@"
LAYERS = ["", ".usda", ".usdc", ".usd"]


def read_layers(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(path, text) of each file; malformed bytes are replaced, or with ``strict`` an error."""
    if not strict:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.validate_utf8(F.col("content").cast("string")).alias("text"))


def lines(layers: DataFrame) -> DataFrame:
    """(path, ln, line, before, depth): brace depth before and after each line."""
    split = layers.select("path", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    change = F.length(F.translate("line", "}", "")) - F.length(F.translate("line", "{", ""))
    depth = F.sum("change").over(Window.partitionBy("path").orderBy("ln"))
    return split.withColumn("change", change).withColumn("depth", depth).select("path", F.col("ln").cast("long").alias("ln"), "line", (F.col("depth") - F.col("change")).alias("before"), "depth")


def prims(numbered: DataFrame, kinds: Sequence[str] | None = None, without: Sequence[str] = ()) -> DataFrame:
    """(path, ln, kind, name, before) of each typed definition; only of the given kinds, and of none of those in ``without``."""
    found = numbered.filter(F.contains("line", F.lit("def")) & F.col("line").rlike(DEFINITION)).select("path", "ln", F.regexp_extract("line", DEFINITION, 1).alias("kind"), F.regexp_extract("line", DEFINITION, 2).alias("name"), "before")
    if kinds is not None:
        found = found.filter(F.col("kind").isin(*kinds))
    return found.filter(~F.col("kind").isin(*without)) if without else found


def top_level(numbered: DataFrame, root: str = "root") -> DataFrame:
    """The definitions that stand on the stage or right under the root, without the root itself."""
    mine = prims(numbered)
    order = Window.partitionBy("path").orderBy("ln")
    top = mine.filter("before = 0").select("path", "ln", F.col("name").alias("top"))
    placed = mine.join(top, ["path", "ln"], "left").withColumn("top", F.last("top", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return placed.filter((F.col("name") != root) & ((F.col("before") == 0) | ((F.col("before") == 1) & (F.col("top") == root)))).drop("top")


def stage_meta(layers: DataFrame) -> DataFrame:
    """Stage data of each layer; missing numbers are 0."""
    key = lambda name: first_match(F.col("text"), rf'(?m)^\s*{name}\s*=\s*"?({NUMBER}|[A-Za-z]+)"?\s*$')
    number = lambda name: F.coalesce(key(name).try_cast("double"), F.lit(0.0))
    return layers.select("path", number("startTimeCode").alias("t0"), number("endTimeCode").alias("t1"), number("timeCodesPerSecond").alias("tps"), number("framesPerSecond").alias("fps"), key("upAxis").alias("up_axis"), key("metersPerUnit").try_cast("double").alias("meters_per_unit"))


def owned(numbered: DataFrame, mode: str = "preceding") -> DataFrame:
    """numbered with ``prim``: the nearest definition before a line, or the one that encloses it."""
    if mode == "preceding":
        name = F.when(F.contains("line", F.lit("def")), F.nullif(F.regexp_extract("line", DEFINITION, 2), F.lit("")))
        return preceding(numbered.withColumn("def", name), ["path"], ["ln"], F.col("def"), "prim", F.lit(STAGE)).drop("def")
    return enclosing(structured(numbered)).select(*numbered.columns, "prim")


def blocks(numbered: DataFrame, attributes: str, mode: str = "preceding") -> DataFrame:
    """Body lines of each time-sample block whose attribute matches the pattern.

    (path, prim, start, indent, decl, attr, ln, body, closed): ``closed`` tells
    whether the block ends in this file at all.  Where numbered has ``at``, the
    character that a line starts with, ``at`` and ``size`` come as well.
    """
    opening = rf"(?U)^(.*?)([ \t]*)(\w+\d*\s+)?({attributes})\.timeSamples\s*="
    found = owned(numbered, mode).withColumn("mark", F.when(F.contains("line", F.lit(".timeSamples")) & F.col("line").rlike(opening), F.struct("ln", "before", "prim", F.regexp_extract("line", opening, 2).alias("indent"), F.concat(F.regexp_extract("line", opening, 3), F.regexp_extract("line", opening, 4)).alias("decl"), F.regexp_extract("line", opening, 4).alias("attr"))))
    upto = Window.partitionBy("path").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("mark", F.last("mark", ignorenulls=True).over(upto)).filter("mark is not null")
    own = Window.partitionBy("path", "mark.ln").orderBy("ln")
    body = F.when(F.col("ln") == F.col("mark.ln"), F.regexp_replace("line", opening, "")).otherwise(F.col("line"))
    # the brace may stand on a later line; the block ends where the depth is back after it
    opened = F.max(F.contains("body", F.lit("{"))).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ended = found.withColumn("body", body).withColumn("ended", opened & (F.col("depth") <= F.col("mark.before")))
    inside = ~F.coalesce(F.max("ended").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    ever = F.max("ended").over(Window.partitionBy("path", "mark.ln"))
    kept = ended.withColumn("inside", inside).withColumn("closed", ever).filter("inside")
    place = ["at", F.length("line").alias("size")] if "at" in numbered.columns else []
    return kept.select("path", "mark.prim", F.col("mark.ln").alias("start"), "mark.indent", "mark.decl", "mark.attr", "ln", "body", "closed", *place)


def block_samples(found: DataFrame) -> DataFrame:
    """(path, prim, attr, start, ln, pos, frame, value array) of the three-number samples of blocks, ``pos`` counting those of a line."""
    one = rf"({NUMBER})\s*:\s*\(\s*({NUMBER})\s*,\s*({NUMBER})\s*,\s*({NUMBER})\s*\)"
    group = lambda i: F.regexp_extract_all("body", F.lit(one), F.lit(i))
    each = found.select("path", "prim", "attr", "start", "ln", F.posexplode(F.arrays_zip(*[group(i).alias(f"g{i}") for i in (1, 2, 3, 4)])).alias("pos", "s"))
    number = lambda i: F.col(f"s.g{i}").try_cast("double")
    return each.select("path", "prim", "attr", "start", "ln", "pos", number(1).alias("frame"), F.array(number(2), number(3), number(4)).alias("value"))


def samples(numbered: DataFrame, attribute: str, mode: str = "preceding") -> DataFrame:
    """(path, prim, attr, start, ln, frame, value array) of three-number samples."""
    return block_samples(blocks(numbered, rf"\Q{attribute}\E", mode)).drop("pos")


def block_raw_samples(found: DataFrame) -> DataFrame:
    """(path, prim, attr, decl, indent, start, ln, frame, raw, closed) of blocks: one sample a line, its value as text."""
    one = rf"^\s*({NUMBER})\s*:\s*(.+?),?\s*$"
    raw = F.trim(F.rtrim(F.regexp_extract("body", one, 2), F.lit(",")))
    return found.filter(F.col("body").rlike(one)).select("path", "prim", "attr", "decl", "indent", "start", "ln", F.regexp_extract("body", one, 1).try_cast("double").alias("frame"), raw.alias("raw"), "closed")


def raw_samples(numbered: DataFrame, attributes: str, mode: str = "preceding") -> DataFrame:
    """(path, prim, attr, decl, indent, start, frame, raw, closed): one sample a line, its value as text."""
    return block_raw_samples(blocks(numbered, attributes, mode)).drop("ln")


def last_of_each_frame(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """samples with one row for each frame of a key: where a frame comes twice, the last one in the order of the file counts."""
    rest = [c for c in samples.columns if c not in (*keys, "frame")]
    held = samples.groupBy(*keys, "frame").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s"))
    return held.select(*keys, "frame", *[f"s.{c}" for c in rest])


def token_samples(numbered: DataFrame, attribute: str = "visibility", mode: str = "preceding") -> DataFrame:
    """(path, prim, frame, token)."""
    one = rf'({NUMBER})\s*:\s*"(\w+)"'
    each = blocks(numbered, rf"\Q{attribute}\E", mode).select("path", "prim", F.explode(F.arrays_zip(F.regexp_extract_all("body", F.lit(one), F.lit(1)).alias("f"), F.regexp_extract_all("body", F.lit(one), F.lit(2)).alias("t"))).alias("s"))
    return each.select("path", "prim", F.col("s.f").try_cast("double").alias("frame"), F.col("s.t").alias("token"))


def asset_references(layers: DataFrame) -> DataFrame:
    """(path, asset): referenced files that are not layers themselves."""
    each = layers.select("path", F.explode(F.regexp_extract_all("text", F.lit(ASSET), F.lit(1))).alias("asset"))
    return each.filter(~extension(F.col("asset")).isin(*LAYERS))


def present_and_missing(wanted: DataFrame, there: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """wanted rows that ``there`` has, and those that it lacks."""
    return wanted.join(there.select(key).distinct(), key, "left_semi"), wanted.join(there.select(key).distinct(), key, "left_anti")


def with_fallback(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``first``, and those of ``second`` for keys that it lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def attribute_counts(layers: DataFrame, attributes: list[str]) -> DataFrame:
    """Time-sample blocks of each attribute in each layer."""
    named: list[Column] = [F.regexp_count("text", F.lit(rf"\Q{a}\E\.timeSamples\s*=")).alias(a) for a in attributes]
    return layers.select("path", *named)
