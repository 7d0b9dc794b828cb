"""Files that layers refer to: found beside the layers, packed with them, or told as missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinotable.functions.columns import escaped, extension, file_name, folder_name, joined_path, unescaped
from kinotable.sources.container_files import write_containers
from kinotable.sources.layers import ASSET, LAYERS


def references(layers: DataFrame) -> DataFrame:
    """(path, place, asset, name, full): each file that a layer (path, text) refers to, once.

    ``place`` counts them from 1 in the order in which they first come,
    ``name`` is theirs in a package: as it is written without a leading
    ``./``, and of an absolute path the last part alone.  ``full`` is where
    they should be, without escapes: absolute as it is, else relative to the
    layer's folder.  A layer's path is a URI with escapes, as ``read_layers`` gives it.
    """
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(ASSET), F.lit(1)))
    own = F.filter(found, lambda a: ~extension(a).isin(*LAYERS))
    each = layers.select("path", F.posexplode(own).alias("place", "asset"))
    asset = F.col("asset")
    bare = F.regexp_replace(asset, r"^\./", "")
    own = unescaped(F.col("path"))
    scheme = F.regexp_extract(own, r"^([A-Za-z][\w+.-]*:(?://[^/]*)?)", 1)
    absolute = asset.startswith("/")
    name = F.when(bare.startswith("/"), file_name(bare)).otherwise(bare)
    full = F.when(absolute, F.concat(scheme, asset)).otherwise(joined_path(folder_name(own), asset))
    return each.select("path", (F.col("place") + 1).alias("place"), "asset", name.alias("name"), full.alias("full"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(full, length) of the files below a folder, without escapes; no content is read."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return there.select(F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("full"), "length")


def found_and_missing(wanted: DataFrame, there: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references whose file is there (with its length), and (path, asset) of the others."""
    one = there.groupBy("full").agg(F.max("length").alias("length"))
    return wanted.join(one, "full"), wanted.join(one, "full", "left_anti").select("path", "asset")


def package_files(layers: DataFrame, found: DataFrame) -> DataFrame:
    """(package, place, name, data, source): the layer itself first, then its files, to be copied from where they are."""
    package = lambda path: F.concat(F.regexp_replace(file_name(unescaped(path)), r"\.[^.]*$", ""), F.lit(".usdz"))
    root = layers.select(package(F.col("path")).alias("package"), F.lit(0).alias("place"), file_name(unescaped(F.col("path"))).alias("name"), F.encode("text", "UTF-8").alias("data"), F.lit(None).cast("string").alias("source"))
    # two references may ask for one name in the package: the first one gets it
    first = found.groupBy("path", "name").agg(F.min_by(F.struct("place", "full"), "place").alias("f"))
    rest = first.select(package(F.col("path")).alias("package"), F.col("f.place").alias("place"), "name", F.lit(None).cast("binary").alias("data"), escaped(F.col("f.full")).alias("source"))
    return root.unionByName(rest)


def export(layers: DataFrame, there: DataFrame, folder: str) -> DataFrame:
    """Writes a container for each layer with the files that it refers to; returns (path, asset) of those that are missing."""
    found, missing = found_and_missing(references(layers), there)
    write_containers(package_files(layers, found), folder)
    return missing


def report_missing(missing: DataFrame) -> DataFrame:
    """(path, missing): a layer's missing files in order."""
    return missing.groupBy("path").agg(F.array_sort(F.collect_set("asset")).alias("missing"))
