"""Queries over scene layers and catalogues that are made from the plain tables, each with SQL that gives the same rows.

Each user's events become a layer: a mesh whose scale and translation have a
sample for each day, with the day's greatest value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinotable.functions import columns as C
from kinotable.operators import catalogue, geometry, rewrite, rules, selection
from kinotable.plans import modes
from kinotable.queries import ORACLES, QUERIES, _doubles, _query, _rounded, _samples, _table
from kinotable.sources import containers, layers
from kinotable.sources.structure import dealt

__all__ = ["ORACLES", "QUERIES"]

_K = "k as (select user_id, dayofyear(ts) d, max(value) v from events group by user_id, dayofyear(ts)), n as (select user_id, count(*) k, user_id % 10 = 0 cam, 'u' || user_id path from k group by user_id)"
_V = "cast(cast(v as decimal(10, 2)) as varchar)"
_HEAD = '#usda 1.0\n(\n    startTimeCode = 1\n    endTimeCode = 31\n    timeCodesPerSecond = 24\n    upAxis = "Y"\n)\ndef Xform "root"\n{\n    def Mesh "'
_CAMERA = '    def Camera "cam"\n    {\n    }\n'


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy("user_id", F.dayofyear("ts").alias("d")).agg(F.max("value").alias("v"))


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of each user; the translation's brace stands on a line of its own."""
    days = _days(spark, sf_dir).withColumn("v", F.col("v").cast("decimal(10,2)").cast("string"))
    held = days.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("s")).withColumn("path", F.concat(F.lit("u"), "user_id"))
    each = lambda make: F.array_join(F.transform("s", lambda x: F.concat(F.lit("            "), x["d"].cast("string"), F.lit(": ("), make(x["v"]), F.lit("),\n"))), "")
    scale = F.concat(F.lit("        float3 xformOp:scale.timeSamples = {\n"), each(lambda v: F.concat_ws(", ", v, v, v)), F.lit("        }\n"))
    moves = F.concat(F.lit("        double3 xformOp:translate.timeSamples =\n        {\n"), each(lambda v: F.concat_ws(", ", F.lit("0"), v, F.lit("0"))), F.lit("        }\n"))
    camera = F.when(F.col("user_id") % 10 == 0, _CAMERA).otherwise("")
    return dealt(held.select("path", F.concat(F.lit(_HEAD), "path", F.lit('"\n    {\n'), scale, moves, F.lit("        asset inputs:file = @tex/"), "path", F.lit(".png@\n    }\n"), camera, F.lit("}\n")).alias("text")))


@_query(f"with {_K} select path, 20 + 2 * k + 3 * cam::int lines, cast(3 as bigint) deepest, cast(19 + 6 * k + 4 * cam::int as bigint) depths from n")
def layer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.lines(_layers(spark, sf_dir)).groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.max("depth").cast("long").alias("deepest"), F.sum("depth").alias("depths"))


@_query(f"with {_K} select path, cast(7 as bigint) ln, 'Xform' kind, 'root' \"name\" from n union all select path, 9, 'Mesh', path from n union all select path, 18 + 2 * k, 'Camera', 'cam' from n where cam")
def layer_prims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.prims(layers.lines(_layers(spark, sf_dir))).drop("before")


@_query(f"with {_K} select path, 'Mesh' kind, path \"name\" from n union all select path, 'Camera', 'cam' from n where cam")
def layer_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.top_level(layers.lines(_layers(spark, sf_dir))).select("path", "kind", "name")


@_query(f"with {_K} select path, 1.0::double t0, 31.0::double t1, 24.0::double tps, 0.0::double fps, 'Y' up_axis, round(30.0 / 24, 6)::double \"seconds\" from n")
def layer_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layers.stage_meta(_layers(spark, sf_dir))
    rate = C.first_nonzero(F.col("tps"), F.col("fps"))
    return found.select("path", "t0", "t1", "tps", "fps", "up_axis", _rounded(C.seconds(F.col("t0"), F.col("t1"), rate)).alias("seconds"))


@_query(f"with {_K} select path, path prim, cast(d as double) frame, v x from k join n using (user_id)")
def layer_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layers.samples(layers.lines(_layers(spark, sf_dir)), "xformOp:scale")
    return found.select("path", "prim", "frame", F.col("value")[0].alias("x"))


@_query(f"with {_K} select path, path prim, cast(d as double) frame, '(0, ' || {_V} || ', 0)' raw from k join n using (user_id)")
def layer_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layers.raw_samples(layers.lines(_layers(spark, sf_dir)), r"xformOp:translate")
    return found.filter("closed").select("path", "prim", "frame", "raw")


@_query(f"with {_K} select path, '<stage>' prim, cast(7 as bigint) lines from n union all select path, 'root', 2 from n union all select path, path, 11 + 2 * k - 2 * cam::int from n union all select path, 'cam', 5 from n where cam")
def layer_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.owned(layers.lines(_layers(spark, sf_dir))).groupBy("path", "prim").agg(F.count(F.lit(1)).alias("lines"))


@_query(f"with {_K} select path, 'tex/' || path || '.png' asset, path || '.png' file, '.png' extension, 1 scales, 1 moves from n")
def layer_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _layers(spark, sf_dir)
    counts = layers.attribute_counts(made, ["xformOp:scale", "xformOp:translate"]).toDF("path", "scales", "moves")
    return layers.asset_references(made).join(counts, "path").select("path", "asset", C.file_name(F.col("asset")).alias("file"), C.extension(F.col("asset")).alias("extension"), "scales", "moves")


_RUNS = f"{_K}, u as (select user_id, cast(d as double) f, v from k), seg as (select user_id, f a, v va, lead(f) over (partition by user_id order by f) b, lead(v) over (partition by user_id order by f) vb from u), e as (select user_id, min(a) k0, max(a) k1, min_by(va, a) v0, max_by(va, a) v1, max(va) top from seg group by user_id), g as (select cast(range as double) f from range(1, 32)), s as (select user_id, f, case when f <= k0 then v0 when f >= k1 then v1 else va + (vb - va) * (f - a) / (b - a) end > 0.5 * top seen from (select e.user_id, k0, k1, v0, v1, top, g.f, a, va, b, vb from e cross join g left join seg on seg.user_id = e.user_id and seg.a <= g.f and g.f < seg.b and g.f > e.k0 and g.f < e.k1)), c as (select user_id, cast(f as int) f, case when seen then 'inherited' else 'invisible' end token from (select *, lag(seen) over (partition by user_id order by f) p from s) where p is null or p <> seen)"


@_query(f"with {_RUNS} select 'u' || user_id path, cast(f as double) frame, token from c")
def frozen_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rewrite.frozen(_layers(spark, sf_dir))
    return layers.token_samples(layers.lines(done)).select("path", "frame", "token")


_PLAIN = f"regexp_replace({_V}, '\\.?0+$', '')"


@_query(
    f"with {_RUNS}, big as (select user_id, {_PLAIN} g from (select user_id, min_by(v, d) v from k join e using (user_id) where v > 0.5 * top group by user_id)), "
    f"vis as (select user_id, string_agg('            ' || f || ': \"' || token || '\",' || chr(10), '' order by f) t, min(case when token = 'inherited' then f end) f1 from c group by user_id), "
    f"still as (select user_id, {_V} t from (select user_id, coalesce(max(case when d = f1 then v end), min_by(v, d)) v from k join vis using (user_id) group by user_id)) "
    f"select path, md5('{_HEAD}' || path || '\"' || chr(10) || '    {{' || chr(10) || '        float3 xformOp:scale = (' || g || ', ' || g || ', ' || g || ')' || chr(10) || '        token visibility.timeSamples = {{' || chr(10) || vis.t || '        }}' || chr(10) || '        double3 xformOp:translate = (0, ' || still.t || ', 0)' || chr(10) || '        asset inputs:file = @tex/' || path || '.png@' || chr(10) || '    }}' || chr(10) || case when cam then '{_CAMERA}' else '' end || '}}' || chr(10)) digest "
    "from n join big using (user_id) join vis using (user_id) join still using (user_id)"
)
def frozen_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.frozen(_layers(spark, sf_dir)).select("path", F.md5("text").alias("digest"))


@_query(
    f"with {_K}, m as (select path, cam, count(distinct v) > 1 moves, count(*) filter (v < 1e-9) zero from k join n using (user_id) group by path, cam) "
    "select path, 'no moving translate' \"check\", not moves ok, moves::int::varchar detail from m union all select path, 'no matrix samples', true, '0' from m union all select path, 'no zero scale', zero = 0, zero::varchar from m "
    "union all select path, 'no cameras or lights', not cam, cam::int::varchar from m union all select path, 'visibility', true, 'none' from m union all select path, 'short time codes', true, '24.0' from m"
)
def layer_check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.run("diagnose", _layers(spark, sf_dir))


@_query(f"with {_K} select path, true ok, '' problems from n")
def freeze_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes.run("verify", _layers(spark, sf_dir)).select("path", "ok", F.array_join("problems", "|").alias("problems"))


@_query("select 'p' || p_partkey path, 'root.usda' \"name\", strlen(p_name) size, true stored, true aligned, true crc_ok from part union all select 'p' || p_partkey, p_brand || '.png', strlen(p_type), true, true, true from part")
def container_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").withColumn("package", F.concat(F.lit("p"), "p_partkey"))
    file = lambda place, name, data: F.struct(F.lit(place).alias("place"), name.alias("name"), F.encode(data, "UTF-8").alias("data"))
    files = part.select("package", F.explode(F.array(file(0, F.lit("root.usda"), F.col("p_name")), file(1, F.concat("p_brand", F.lit(".png")), F.col("p_type")))).alias("f")).select("package", "f.*")
    found = containers.container_entries(containers.packages(files).withColumnRenamed("package", "path"))
    return found.select("path", "name", "size", (F.col("method") == 0).alias("stored"), (F.pmod("data_off", F.lit(64)) == 0).alias("aligned"), "crc_ok")


@_query("select 'p' || p_partkey path, true ok from part")
def container_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    made = modes.run("export", part.select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.col("p_name").alias("text"))).withColumnRenamed("package", "path")
    return rules.verdict(rules.packaging(containers.container_entries(made))).select("path", "ok")


@_query(f"with {_K}, m as (select user_id, d, v > 0.5 * max(v) over (partition by user_id) st from k), a as (select user_id, d, st from m union all select user_id, 1, false from k group by user_id having min(d) > 1), l as (select *, lag(st) over (partition by user_id order by d) p from a) select user_id, cast(d as int) frame, case when st then 'inherited' else 'invisible' end token from l where p is null or p <> st")
def raw_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rewrite.raw_visibility(_days(spark, sf_dir).filter("v is not null"), ["user_id"], "d", F.col("v"), F.lit(1))
    return found.select("user_id", F.col("frame").cast("int").alias("frame"), "token")


@_query(f"with {_K}, u as (select user_id, d, v, lead(d) over (partition by user_id order by d) d2, lead(v) over (partition by user_id order by d) v2 from k) select user_id, min(v) < 100 and max(v) > 100 crosses, count(*) filter ((v > 100) <> (v2 > 100) and d2 - d <> 1) = 0 sharp, max(v) > 100 shown, min(v) < 100 and max(v) > 100 and count(*) filter ((v > 100) <> (v2 > 100) and d2 - d <> 1) = 0 ok from u group by user_id")
def object_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir).withColumn("d", F.col("d").cast("double"))
    found = rules.object_checks(days, days.select("user_id", "d"), ["user_id"], "d", "v", 100.0)
    return found.select("user_id", "crosses", "sharp", F.col("first_on").isNotNull().alias("shown"), "ok")


_CATALOGUE = "select user_id, case when user_id % 3 = 0 then 'MESH' else 'EMPTY' end kind, event_type, count(*) n from events group by user_id, event_type"


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, kind, paths): users as objects, event types as channels."""
    found = catalogue.key_counts(_table(spark, sf_dir, "events"), ["user_id"], "event_type")
    return found.withColumn("kind", F.when(F.col("user_id") % 3 == 0, "MESH").otherwise("EMPTY"))


@_query(f"select user_id, string_agg(event_type || ':' || n, ',' order by event_type) paths, count(*) filter (event_type = 'purchase') > 0 and max(kind) = 'MESH' candidate from ({_CATALOGUE}) group by user_id")
def key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.array_join(F.transform(F.array_sort(F.map_entries("paths")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return _objects(spark, sf_dir).select("user_id", told.alias("paths"), catalogue.is_candidate(F.col("kind"), F.col("paths"), "purchase").alias("candidate"))


@_query(f"select user_id, kind from (select user_id, max(kind) kind, count(*) c from ({_CATALOGUE}) group by user_id) order by kind <> 'MESH', c desc, user_id limit 20")
def catalogue_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.first_listed(_objects(spark, sf_dir), F.col("kind"), F.col("paths"), F.col("user_id"), 20).select("user_id", "kind")


@_query("select user_id, string_agg(distinct event_type, '|' order by event_type) modes, bool_and(event_type = 'scale' or event_type like 'hide_%') switches, count(*) filter (event_type = 'location') = 0 free from events group by user_id")
def channel_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalogue.modes(_table(spark, sf_dir, "events"), ["user_id"], "event_type")
    return found.select("user_id", F.array_join("modes", "|").alias("modes"), rules.only_switches(F.col("modes")).alias("switches"), (~F.exists("modes", rules.forbidden_channel)).alias("free"))


@_query("select max(case when p_brand = 'Brand#1' then p_retailprice else 0 end) scale from part")
def scene_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.scene_scale(_table(spark, sf_dir, "part"), F.col("p_retailprice"), F.col("p_brand"), "Brand#1")


@_query(f"with {_K}, f as (select user_id, user_id % 7 \"group\", min(d) filter (v > 100) first_on from k group by user_id), o as (select *, row_number() over (partition by \"group\" order by coalesce(first_on, 1000000), user_id) - 1 i, 240.0::double / count(*) over (partition by \"group\") span from f) select user_id, \"group\", first_on, cast(round_even(1 + i * span, 0) as int) \"start\", least(cast(round_even(1 + (i + 1) * span, 0) as int) - 1, 240) stop from o")
def retime_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir).withColumn("group", F.col("user_id") % 7).withColumn("d", F.col("d").cast("long"))
    return catalogue.retime_plan(days, ["group"], "user_id", "d", F.col("v") > 100, 1, 240)


@_query(f"with {_K} select user_id, count(*) n, array_to_string(list_slice(list(cast(d as int) order by d), 1, 10), '|') frames from k where v < 20 group by user_id")
def zero_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir).withColumnRenamed("d", "frame")
    # a day of exactly 20 has no size below it
    found = rules.zero_frames(days, ["user_id"], F.when(F.col("v") < 20, 0.0).otherwise(1.0))
    return found.select("user_id", "n", F.array_join(F.transform("frames", lambda x: x.cast("string")), "|").alias("frames"))


@_query(QUERIES and ORACLES["origin_verdicts"].replace("select label, case", "select label % 2 side, case when bool_or(away / radius >= 2) then 'guilty' when bool_or(away / radius >= 0.5) then 'suspect' else 'ok' end verdict from r join o using (label) group by label % 2 --"))
def worst_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.worst_verdict(QUERIES["origin_verdicts"](spark, sf_dir).withColumn("side", F.col("label") % 2), ["side"])


_POINT = "select label, vec_id, embedding[1]::double x, embedding[2]::double y, embedding[3]::double z from embeddings"
#: A quarter turn about the third axis with a move, by rows.
_TURN = [[0.0, -1.0, 0.0, 2.0], [1.0, 0.0, 0.0, 3.0], [0.0, 0.0, 1.0, 5.0], [0.0, 0.0, 0.0, 1.0]]


def _matrix(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*map(F.lit, row)) for row in rows])


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("label", "vec_id", F.slice(_doubles("embedding"), 1, 3).alias("p"))


@_query(f"select label, round(min(2 - y), 6) lo0, round(max(2 - y), 6) hi0, round(min(3 + x), 6) lo1, round(max(3 + x), 6) hi1, round(min(5 + z), 6) lo2, round(max(5 + z), 6) hi2 from ({_POINT}) group by label")
def world_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.bounds(_points(spark, sf_dir), ["label"], F.col("p"), _matrix(_TURN))
    return found.select("label", *[_rounded(F.col(side)[i]).alias(f"{side}{i}") for i in range(3) for side in ("lo", "hi")])


@_query(f"select vec_id, round(2 - y * s, 6) + 0.0 x, round(3 + x * s, 6) + 0.0 y, round(5 + z * s, 6) + 0.0 z from (select *, case when label = 0 then 1 else label end s from ({_POINT}))")
def baked_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.baked(_points(spark, sf_dir), F.col("p"), _matrix(_TURN), F.col("label").cast("double"))
    return found.select("vec_id", *[(_rounded(F.col("baked")[i]) + 0.0).alias(c) for i, c in enumerate("xyz")])


@_query(f"with b as (select label, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz from ({_POINT}) group by label), w as (select min(lx) lx, max(hx) hx, min(ly) ly, max(hy) hy, min(lz) lz, max(hz) hz from b), d as (select label, -(w.lx + w.hx) / 2 + (b.lx + b.hx) / 2 x, -(w.ly + w.hy) / 2 + (b.ly + b.hy) / 2 y, -(w.lz + w.hz) / 2 + (b.lz + b.hz) / 2 z, sqrt(pow(b.hx - b.lx, 2) + pow(b.hy - b.ly, 2) + pow(b.hz - b.lz, 2)) / 2 half from b, w) select label, round(x, 6) + 0.0 x, round(sqrt(x * x + y * y + z * z), 6) away, case when sqrt(x * x + y * y + z * z) < 1e-3 then 'centred' when sqrt(x * x + y * y + z * z) / half < 0.05 then 'near' else 'off' end verdict, sqrt(x * x + y * y + z * z) <= greatest(1e-3, half * 0.05) \"within\" from d")
def recentred(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = geometry.bounds(_points(spark, sf_dir), ["label"], F.col("p"))
    world = geometry.united(boxes.withColumn("all", F.lit(1)), ["all"]).select("all", F.col("lo").alias("wlo"), F.col("hi").alias("whi"))
    delta = geometry.recentre_delta(F.col("wlo"), F.col("whi"), F.col("lo"), F.col("hi"))
    centre = C.add(C.midpoint(F.col("lo"), F.col("hi")), delta)
    placed = boxes.withColumn("all", F.lit(1)).join(F.broadcast(world), "all").withColumn("c", centre).withColumn("half", C.norm(C.subtract(F.col("hi"), F.col("lo"))) / 2)
    away = C.norm(F.col("c"))
    return placed.select("label", (_rounded(F.col("c")[0]) + 0.0).alias("x"), _rounded(away).alias("away"), rules.pivot_verdict(away, F.col("half")).alias("verdict"), rules.pivot_within(away, F.col("half")).alias("within"))


@_query(f"with u as (select user_id % 10 label, cast(dayofyear(ts) as double) + cast(hour(ts) as double) / 24 f, max(value) v from events group by 1, 2), seg as (select label, f a, v va, lead(f) over (partition by label order by f) b, lead(v) over (partition by label order by f) vb from u), e as (select label, min(a) k0, max(a) k1, min_by(va, a) v0, max_by(va, a) v1 from seg group by label), g as (select unnest([1.0, 8.0, 15.0, 22.0, 30.0])::double f), s as (select label, f, case when f <= k0 then v0 when f >= k1 then v1 else va + (vb - va) * (f - a) / (b - a) end val from (select e.label, k0, k1, v0, v1, g.f, a, va, b, vb from e cross join g left join seg on seg.label = e.label and seg.a <= g.f and g.f < seg.b and g.f > e.k0 and g.f < e.k1)), b as (select label, min(x) lx, max(x) hx, min(y) ly from ({_POINT}) group by label) select label, g.f frame, round(lx + coalesce(val, 0), 6) lo0, round(hx + coalesce(val, 0), 6) hi0, round(ly, 6) lo1 from b cross join g left join s using (label, f)")
def boxes_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = geometry.bounds(_points(spark, sf_dir), ["label"], F.col("p"))
    moves = _samples(spark, sf_dir).groupBy((F.col("user_id") % 10).cast("int").alias("label"), F.col("f").alias("frame")).agg(F.max("v").alias("value")).withColumn("axis", F.lit(0))
    frames = boxes.select("label", F.explode(F.array(*[F.lit(float(x)) for x in (1, 8, 15, 22, 30)])).alias("frame"))
    found = geometry.boxes_at(boxes, moves, frames, ["label"])
    return found.select("label", "frame", _rounded(F.col("lo")[0]).alias("lo0"), _rounded(F.col("hi")[0]).alias("hi0"), _rounded(F.col("lo")[1]).alias("lo1"))


@_query("select event_id, round(value + case when event_type = 'click' and user_id % 2 = 0 then [1.5, -2.0, 4.0][1 + event_id % 3] else 0 end, 6) \"value\" from events")
def moved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    keys = events.select("event_id", F.col("user_id").alias("object"), F.when(F.col("event_type") == "click", "location").otherwise(F.col("event_type")).alias("data_path"), (F.col("event_id") % 3).cast("int").alias("array_index"), F.lit(0).alias("frame"), "value")
    roots = events.filter("user_id % 2 = 0").select(F.col("user_id").alias("object"))
    found = geometry.moved_keys(keys, roots, F.array(F.lit(1.5), F.lit(-2.0), F.lit(4.0)))
    return found.select("event_id", _rounded("value").alias("value"))


@_query("select s_suppkey, case when s_suppkey % 2 = 1 and s_acctbal <> 0 then s_acctbal when s_nationkey <> 0 then s_nationkey else 0 end first_value, case when s_nationkey = 0 then null else round(s_acctbal / s_nationkey, 6) end \"seconds\", s_name || '.A.PNG' file, '.png' extension, s_suppkey + (64 - s_suppkey % 64) % 64 size, contains(s_name, '1') exact, contains(upper(s_name), 'SUPP') folded, contains(upper(s_name), 'supp') plain, s_suppkey % 2 = 0 same from supplier")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, name = _table(spark, sf_dir, "supplier"), F.col("s_name")
    path = F.concat(F.lit("a/b.c/"), name, F.lit(".A.PNG"))
    odd = (F.col("s_suppkey") % 2).cast("double")
    unit = F.array(F.array(F.lit(1.0), odd), F.array(F.lit(0.0), F.lit(1.0)))
    found = [C.first_nonzero(F.col("s_acctbal") * odd, F.col("s_nationkey").cast("double")).alias("first_value"), _rounded(C.seconds(F.lit(0.0), F.col("s_acctbal"), F.col("s_nationkey").cast("double"))).alias("seconds")]
    found += [C.file_name(path).alias("file"), C.extension(path).alias("extension"), C.aligned(F.col("s_suppkey")).alias("size")]
    found += [C.contains_any(name, ["1"]).alias("exact"), C.contains_any(name, ["supp"], "fold").alias("folded"), C.contains_any(name, ["supp"], "text").alias("plain"), C.is_identity(unit).alias("same")]
    return supplier.select("s_suppkey", *found)


@_query("select user_id, string_agg(distinct case when event_type in ('click', 'purchase') then event_type end, '|' order by case when event_type in ('click', 'purchase') then event_type end) kept, coalesce(string_agg(distinct case when event_type not in ('click', 'purchase') then event_type end, '|' order by case when event_type not in ('click', 'purchase') then event_type end), '') dropped from events group by user_id")
def supported_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, dropped = selection.supported(F.col("paths"), ["click", "purchase"])
    return _objects(spark, sf_dir).select("user_id", F.array_join(F.array_sort(F.map_keys(kept)), "|").alias("kept"), F.array_join(dropped, "|").alias("dropped"))


@_query("select o_custkey, 'order' \"source\" from orders where o_orderstatus = 'P' group by o_custkey union all select c_custkey, 'customer' from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def fallback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_custkey").distinct().withColumn("source", F.lit("order"))
    second = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit("customer").alias("source"))
    return layers.with_fallback(first, second, ["o_custkey"])
