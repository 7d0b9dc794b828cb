"""Queries over trees of objects and of definitions, and over files: layers and containers that are written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinotable.operators import hierarchy
from kinotable.plans.rounds import scratch
from kinotable.queries import ORACLES, _query, _rounded, _table
from kinotable.scene_queries import _layers
from kinotable.sources import assets, container_files, sinks, stage_source, structure

#: Parts as a binary tree: part k stands under part k / 2.  The same numbers in SQL and in columns.
_PARTS = """p as (select p_partkey k, nullif(p_partkey // 2, 0) parent, p_size::double lx, (p_partkey % 7)::double ly, (p_partkey % 3)::double - 1 lz, case when p_partkey % 5 = 0 then 0.5 else 0 end dx,
 1.0::double qw, (p_partkey % 2)::double qx, 0.0::double qy, (p_partkey % 4)::double qz, p_partkey % 10 = 0 turns, 1 + (p_partkey % 3)::double / 8 sx, 1.0::double sy, (1 - (p_partkey % 2)::double / 8) * case when p_partkey % 5 = 0 then 1.25 else 1 end sz from part),
t as (select *, case when turns then qw - qx else qw end w, case when turns then qx + qw else qx end x, case when turns then qy - qz else qy end y, case when turns then qz + qy else qz end z from p),
u as (select * exclude (w, x, y, z), w / sqrt(w * w + x * x + y * y + z * z) w, x / sqrt(w * w + x * x + y * y + z * z) x, y / sqrt(w * w + x * x + y * y + z * z) y, z / sqrt(w * w + x * x + y * y + z * z) z from t),
l as (select k, parent, [(1 - 2 * (y * y + z * z)) * sx, 2 * (x * y - w * z) * sy, 2 * (x * z + w * y) * sz, lx + dx, 2 * (x * y + w * z) * sx, (1 - 2 * (x * x + z * z)) * sy, 2 * (y * z - w * x) * sz, ly, 2 * (x * z - w * y) * sx, 2 * (y * z + w * x) * sy, (1 - 2 * (x * x + y * y)) * sz, lz, 0, 0, 0, 1] m from u)"""
_TIMES = "list_transform(range(0, 16), lambda i: " + " + ".join(f"w.m[4 * (i // 4) + {j + 1}] * l.m[i % 4 + {4 * j + 1}]" for j in range(4)) + ")"
_WORLDS = f"with recursive {_PARTS}, w as (select k, m from l where parent is null union all select l.k, {_TIMES} m from l join w on l.parent = w.k)"


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    number = lambda c: c.cast("double")
    fifth = key % 5 == 0
    return _table(spark, sf_dir, "part").select(
        key.alias("name"), F.when(key >= 2, F.floor(key / 2)).alias("parent"),
        F.array(number(F.col("p_size")), number(key % 7), number(key % 3) - 1).alias("location"),
        F.array(F.lit(1.0), number(key % 2), F.lit(0.0), number(key % 4)).alias("rotation"),
        F.array(1 + number(key % 3) / 8, F.lit(1.0), 1 - number(key % 2) / 8).alias("scale"),
        F.when(fifth, F.array(*map(F.lit, (0.5, 0.0, 0.0)))).alias("delta_location"),
        F.when(key % 10 == 0, F.array(*map(F.lit, (1.0, 1.0, 0.0, 0.0)))).alias("delta_rotation"),
        F.when(fifth, F.array(*map(F.lit, (1.0, 1.0, 1.25)))).alias("delta_scale"),
    )


def _cells(matrix: str) -> list[Column]:
    return [(_rounded(F.col(matrix)[i][j]) + 0.0).alias(f"m{4 * i + j}") for i in range(3) for j in range(4)]


_CELLS = ", ".join(f"round(m[{i + 1}], 6) + 0.0 m{i}" for i in range(12))


@_query(f"{_WORLDS} select k, {_CELLS} from w")
def world_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy.world_matrices(hierarchy.local_matrices(_objects(spark, sf_dir)))
    return found.select(F.col("name").alias("k"), *_cells("world"))


@_query(f"{_WORLDS} select k, case when k % 5 <> 0 then parent end parent, {_CELLS.replace('m[', '(case when k % 5 = 0 then w.m else l.m end)[')} from l join w using (k)")
def unparented(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = hierarchy.absorbed(_objects(spark, sf_dir), F.col("name") % 5 == 0)
    return done.select(F.col("name").alias("k"), "parent", *_cells("matrix"))


@_query(f"with {_PARTS} select k, parent, {_CELLS} from l")
def deltas_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = hierarchy.absorbed(_objects(spark, sf_dir), F.col("name") % 5 == 0, unparent=False)
    return done.select(F.col("name").alias("k"), "parent", *_cells("matrix"))


#: Each customer's orders as definitions inside each other: order i of a customer stands at level 1 + i % 5.
_NEST = "with o as (select o_custkey c, o_orderkey k, row_number() over (partition by o_custkey order by o_orderkey) - 1 i from orders), s as (select c, k, i, i % 5 lvl, i - i % 5 g from o)"


def nested_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a layer for each customer, in which runs of five orders are definitions inside each other, each with samples after its child."""
    orders = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("o"))
    key = lambda i: F.element_at("o", (i + 1).cast("int")).cast("string")
    pad = lambda i: F.repeat(F.lit("  "), (i % 5 + 1).cast("int"))
    last = F.size("o") - 1
    # the brace stands on a line of its own, after metadata that has braces
    head = lambda i: F.concat(pad(i), F.lit('def Mesh "k'), key(i), F.lit('" (\n'), pad(i), F.lit("customData = {\n"), pad(i), F.lit("}\n"), pad(i), F.lit(")\n"), pad(i), F.lit("{\n"))
    tail = lambda i: F.concat(pad(i), F.lit("double3 xformOp:translate.timeSamples = {\n"), pad(i), F.lit("1: (0, "), key(i), F.lit(", 0),\n"), pad(i), F.lit("}\n"), pad(i), F.lit("}\n"))
    close = lambda i: F.array_join(F.transform(F.sequence(i % 5, F.lit(0), F.lit(-1)), lambda d: tail(i - i % 5 + d)), "")
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(head(i), F.when((i % 5 == 4) | (i == last), close(i)).otherwise("")))
    return structure.dealt(orders.select(F.concat(F.lit("c"), "o_custkey").alias("path"), F.concat(F.lit('#usda 1.0\ndef Xform "root"\n{\n'), F.array_join(each, ""), F.lit("}\n")).alias("text")))


@_query(f"{_NEST}, a as (select *, '/root/' || string_agg('k' || k, '/') over (partition by c, g order by lvl rows between unbounded preceding and current row) p from s) select 'c' || c path, 'k' || k prim, p prim_path, '1: (0, ' || k || ', 0),' sample from a")
def nested_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = structure.text_lines(nested_layers(spark, sf_dir))
    found = structure.enclosing(structure.structured(lines, r"\QxformOp:translate\E", levels=7)).filter("block is not null and line like '%: (%'")
    return found.select("path", "prim", structure.prim_path(F.col("prims")).alias("prim_path"), F.trim("line").alias("sample"))


@_query(f"{_NEST} select 'c' || c path, cast(3 + 9 * count(*) + 2 as bigint) \"lines\", cast(3 + max(lvl) as bigint) deepest, cast(sum(case when lvl = 4 or i = n - 1 then 1 else 0 end) as bigint) leaves from (select *, count(*) over (partition by c) n from s) group by c")
def nested_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = structure.text_lines(nested_layers(spark, sf_dir))
    depth = lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.max(F.greatest("before", "depth")).alias("deepest"))
    names = structure.structured(lines, levels=7).filter("line like '%timeSamples%'").select("path", "prims")
    # each name counts for itself and tells its parent of a child; all of a path is in one task already
    told = F.array(F.struct("prims", F.lit(False).alias("child")), F.struct(F.slice("prims", F.lit(1), F.size("prims") - 1).alias("prims"), F.lit(True).alias("child")))
    each = names.select("path", F.explode(told).alias("t")).groupBy("path", "t.prims").agg(F.count(F.when(~F.col("t.child"), 1)).alias("n"), F.some("t.child").alias("parent"))
    leaves = each.filter("n > 0 and not parent").groupBy("path").agg(F.sum("n").alias("leaves"))
    return depth.join(leaves, "path")


#: Customers as layers in folders of their nations, that refer to files by the forms that paths take.
_FORMS = ["tex/k{}.png", "./k{}.png", "../n{}/k.png", "/abs/{}/../n.png", "tex//./k{}.png", "../../../{}.png"]


def _layers_with_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer")
    pattern = lambda f: F.concat(*[x for i, part in enumerate(f.split("{}")) for x in ([F.col("c_nationkey").cast("string")] if i else []) + [F.lit(part)]])
    lines = F.concat_ws("\n", *[F.concat(F.lit("  asset a = @"), pattern(f), F.lit("@")) for f in _FORMS], F.lit("  prepend references = @base.usda@"))
    return customer.select(F.concat(F.lit("file:///lib/n"), "c_nationkey", F.lit("/c"), "c_custkey", F.lit(".usda")).alias("path"), lines.alias("text"))


_WANTED = "select 'file:///lib/n' || n || '/c' || c_custkey || '.usda' path, place, asset, \"name\", \"full\" from (select c_custkey, c_nationkey n from customer), lateral (select * from (values (1, 'tex/k' || n || '.png', 'tex/k' || n || '.png', 'file:///lib/n' || n || '/tex/k' || n || '.png'), (2, './k' || n || '.png', 'k' || n || '.png', 'file:///lib/n' || n || '/k' || n || '.png'), (3, '../n' || n || '/k.png', '../n' || n || '/k.png', 'file:///lib/n' || n || '/k.png'), (4, '/abs/' || n || '/../n.png', 'n.png', 'file:///abs/' || n || '/../n.png'), (5, 'tex//./k' || n || '.png', 'tex//./k' || n || '.png', 'file:///lib/n' || n || '/tex/k' || n || '.png'), (6, '../../../' || n || '.png', '../../../' || n || '.png', 'file:///' || n || '.png')) t(place, asset, \"name\", \"full\"))"


@_query(_WANTED)
def asset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.references(_layers_with_assets(spark, sf_dir))


#: Files that are there: those of nations whose suppliers number two or more.
_THERE = "select 'file:///lib/n' || s_nationkey || '/tex/k' || s_nationkey || '.png' \"full\" from supplier group by s_nationkey having count(*) > 1"


@_query(f"with w as ({_WANTED}), t as ({_THERE}) select path, count(*) filter (\"full\" in (select \"full\" from t)) \"found\", array_to_string(list_sort(list(distinct asset) filter (\"full\" not in (select \"full\" from t))), '|') missing from w group by path")
def assets_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("length")).filter("length > 1")
    there = nations.select(F.concat(F.lit("file:///lib/n"), "s_nationkey", F.lit("/tex/k"), "s_nationkey", F.lit(".png")).alias("full"), "length")
    found, missing = assets.found_and_missing(assets.references(_layers_with_assets(spark, sf_dir)), there)
    told = assets.report_missing(missing).select("path", F.array_join("missing", "|").alias("missing"))
    return told.join(found.groupBy("path").agg(F.count(F.lit(1)).alias("found")), "path", "left").select("path", F.coalesce("found", F.lit(0).cast("long")).alias("found"), "missing")


def _written_parts(spark: SparkSession, sf_dir: str) -> str:
    """A folder of containers of parts, each with its name as the root layer and two more files."""
    part = _table(spark, sf_dir, "part")
    entry = lambda place, name, data: F.struct(F.lit(place).alias("place"), name.alias("name"), F.encode(data, "UTF-8").alias("data"))
    each = F.explode(F.array(entry(0, F.lit("root.usda"), F.col("p_name")), entry(1, F.concat("p_brand", F.lit(".png")), F.repeat("p_type", 50)), entry(2, F.lit("empty"), F.lit(""))))
    # parts whose keys agree in their last two digits share a container
    rows = part.select(F.concat(F.lit("b"), F.col("p_partkey") % 100).alias("package"), "p_partkey", each.alias("f"))
    files = rows.select("package", (F.col("p_partkey") * 3 + F.col("f.place")).cast("int").alias("place"), F.concat("p_partkey", F.lit("/"), "f.name").alias("name"), "f.data")
    folder = scratch(spark)
    container_files.write_containers(files, folder)
    return folder


@_query("with f as (select 'b' || p_partkey % 100 path, p_partkey k, p_name, p_brand, repeat(p_type, 50) t from part) select path, k || '/root.usda' \"name\", strlen(p_name) size, true stored, true aligned, true crc_ok from f union all select path, k || '/' || p_brand || '.png', strlen(t), true, true, true from f union all select path, k || '/empty', 0, true, true, true from f")
def written_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = container_files.container_ranges(spark, _written_parts(spark, sf_dir), 1000)
    return found.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("path"), "name", "size", (F.col("method") == 0).alias("stored"), (F.pmod("data_off", F.lit(64)) == 0).alias("aligned"), "crc_ok")


@_query(ORACLES["layer_samples"].replace("frame, v x from", "frame, 0.0::double x, v y from"))
def sourced_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage_source.register(spark)
    folder = scratch(spark)
    sinks.write_layers(_layers(spark, sf_dir), folder)
    found = spark.read.format("scene_samples").load(folder).filter("attr = 'xformOp:translate'")
    return found.select(F.regexp_extract("path", "path=([^/]*)", 1).alias("path"), "prim", "frame", F.col("value")[0].alias("x"), F.col("value")[1].alias("y"))


@_query(ORACLES["layer_lines"])
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    sinks.write_layers(_layers(spark, sf_dir), folder)
    # the folder itself, as its subfolders are listed by tasks; a pattern is matched one by one
    found = structure.file_lines(spark, folder, chunk=64)
    named = F.regexp_extract("path", "path=([^/]*)", 1).alias("path")
    # the writer's last line break opens no line of its own here
    return found.groupBy(named).agg((F.count(F.lit(1)) + 1).cast("int").alias("lines"), F.max("depth").alias("deepest"), F.sum("depth").alias("depths"))
