"""Queries of rules over data in which every outcome comes up, each with SQL that works the outcome out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinotable.functions import columns as C
from kinotable.operators import catalogue, geometry, rewrite, rules
from kinotable.plans.rounds import kept
from kinotable.queries import ORACLES, _doubles, _query, _rounded, _table
from kinotable.scene_queries import _K, _layers
from kinotable.sources import containers, layers, sinks, structure

#: A customer's orders as points: some about the origin, some off it, some far off; small, middling and wide.
_POINTS = "q as (select o_custkey c, [1.0, 0.1, 5.0][1 + o_custkey % 3]::double s, o_orderkey % 97 - 48 + [0, 40, 300, 0][1 + o_custkey % 4] x, o_orderkey % 53 - 26 y, o_orderkey % 7 z from orders), p as (select c, x * s x, y * s y, z * s z from q)"
_OBJECTS = f"{_POINTS}, m as (select c, avg(x) mx, avg(y) my, avg(z) mz, max(x) - min(x) travel from p group by c), r as (select c, sqrt(mx * mx + my * my + mz * mz) away, travel, max(sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2))) radius from p join m using (c) group by c, mx, my, mz, travel), v as (select c, radius, travel, case when radius <= 1e-9 then 'ok' when away / radius >= 2 then 'guilty' when away / radius >= 0.5 then 'caution' else 'ok' end origin, case when radius > 100 then 'spread' when travel > 20 then 'moving' else 'ok' end spread from r)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, number = F.col("o_custkey"), lambda c: c.cast("double")
    size, shift = F.element_at(F.array(*map(F.lit, (1.0, 0.1, 5.0))), (key % 3 + 1).cast("int")), F.element_at(F.array(*map(F.lit, (0, 40, 300, 0))), (key % 4 + 1).cast("int"))
    orders = _table(spark, sf_dir, "orders")
    place = [number(F.col("o_orderkey") % 97 - 48 + shift), number(F.col("o_orderkey") % 53 - 26), number(F.col("o_orderkey") % 7)]
    return orders.select(key.alias("c"), F.array(*[x * size for x in place]).alias("p"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    travel = points.groupBy("c").agg((F.max(F.col("p")[0]) - F.min(F.col("p")[0])).alias("travel"))
    found = geometry.radii(points, ["c"], F.col("p")).join(travel, "c")
    return found.select("c", rules.origin_verdict(C.norm(F.col("centroid")), F.col("radius")).alias("origin"), rules.spread_verdict(F.col("travel"), F.col("radius"), F.lit(1000.0)).alias("spread"))


@_query(f"with {_OBJECTS} select c, origin, spread from v")
def object_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)


@_query(f"with {_OBJECTS} select c // 3 scene, case when bool_or(origin = 'guilty') then 'guilty' when bool_or(origin = 'caution') then 'suspect' else 'ok' end verdict from v group by c // 3")
def scene_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.worst_verdict(_judged(spark, sf_dir).withColumn("scene", F.floor(F.col("c") / 3)), ["scene"], "origin")


_BOXES = f"{_POINTS}, b as (select c, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz from p group by c), h as (select *, sqrt(pow(hx - lx, 2) + pow(hy - ly, 2) + pow(hz - lz, 2)) / 2 half from b), o as (select *, [0, 0.02, 0.2, 0.0005][1 + c % 4] * case when c % 4 = 3 then 1 else half end away from h)"


@_query(f"with {_BOXES} select c, case when away < 1e-3 then 'centred' when half > 1e-9 and away / half < 0.05 then 'near' else 'off' end verdict, away <= greatest(1e-3, half * 0.05) \"within\" from o")
def pivot_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = geometry.bounds(_points(spark, sf_dir), ["c"], F.col("p")).withColumn("half", C.norm(C.subtract(F.col("hi"), F.col("lo"))) / 2)
    share = F.element_at(F.array(*map(F.lit, (0.0, 0.02, 0.2, 0.0005))), (F.col("c") % 4 + 1).cast("int"))
    away = share * F.when(F.col("c") % 4 == 3, 1.0).otherwise(F.col("half"))
    return boxes.select("c", rules.pivot_verdict(away, F.col("half")).alias("verdict"), rules.pivot_within(away, F.col("half")).alias("within"))


@_query(f"with {_BOXES}, f as (select c // 10 g, (lx + hx) / 2 x, (ly + hy) / 2 y, (lz + hz) / 2 z from b where c % 10 = 1) select c, round((lx + hx) / 2 - f.x, 6) + 0.0 x, round((ly + hy) / 2 - f.y, 6) + 0.0 y, c % 10 = 1 subject, case when sqrt(pow((lx + hx) / 2 - f.x, 2) + pow((ly + hy) / 2 - f.y, 2) + pow((lz + hz) / 2 - f.z, 2)) < 1e-3 then 'centred' when half > 1e-9 and sqrt(pow((lx + hx) / 2 - f.x, 2) + pow((ly + hy) / 2 - f.y, 2) + pow((lz + hz) / 2 - f.z, 2)) / half < 0.05 then 'near' else 'off' end verdict from h join f on f.g = c // 10")
def recentred_on_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = geometry.bounds(_points(spark, sf_dir), ["c"], F.col("p")).withColumn("g", F.floor(F.col("c") / 10))
    subject = boxes.filter("c % 10 = 1").select("g", F.col("lo").alias("slo"), F.col("hi").alias("shi"))
    whole = geometry.united(boxes, ["g"]).select("g", F.col("lo").alias("wlo"), F.col("hi").alias("whi"))
    delta = geometry.recentre_delta(F.col("wlo"), F.col("whi"), F.col("slo"), F.col("shi"), "subject")
    centre = boxes.join(subject, "g").join(whole, "g").withColumn("p", C.add(C.midpoint(F.col("lo"), F.col("hi")), delta))
    half = C.norm(C.subtract(F.col("hi"), F.col("lo"))) / 2
    return centre.select("c", (_rounded(F.col("p")[0]) + 0.0).alias("x"), (_rounded(F.col("p")[1]) + 0.0).alias("y"), (F.col("c") % 10 == 1).alias("subject"), rules.pivot_verdict(C.norm(F.col("p")), half).alias("verdict"))


_CHANNELS = "case event_type when 'click' then 'location' when 'view' then 'scale' when 'purchase' then 'hide_render' when 'signup' then 'hide_viewport' else 'rotation_euler' end"


@_query(f"with e as (select user_id, dayofyear(ts) d, {_CHANNELS} c from events), g as (select user_id, d, string_agg(distinct c, '|' order by c) modes, bool_and(c = 'scale' or c like 'hide_%') switches, bool_and(c not in ('location', 'rotation_euler')) free from e group by user_id, d) select user_id, d, modes, switches, free, (user_id % 3) * 0.008 <= 0.01 and switches fixed from g")
def channel_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    channel = F.when(kind == "click", "location").when(kind == "view", "scale").when(kind == "purchase", "hide_render").when(kind == "signup", "hide_viewport").otherwise("rotation_euler")
    found = catalogue.modes(_table(spark, sf_dir, "events").select("user_id", F.dayofyear("ts").alias("d"), channel.alias("c")), ["user_id", "d"], "c")
    fixed = rules.origin_fixed((F.col("user_id") % 3) * 0.008, F.lit(1.0), F.col("modes"))
    return found.select("user_id", "d", F.array_join(F.array_sort("modes"), "|").alias("modes"), rules.only_switches(F.col("modes")).alias("switches"), (~F.exists("modes", rules.forbidden_channel)).alias("free"), fixed.alias("fixed"))


def _number() -> Column:
    return F.substring("path", 2, 20).cast("long")


#: Frozen layers, some put back as they were or changed by hand.
@_query(f"with {_K} select path, case user_id % 5 when 1 then 'no scale samples|no translate samples|visibility of each' when 2 then 'visibility of each' when 3 then 'no matrix samples' when 4 then 'visibility of each' else '' end problems, user_id % 5 = 0 ok from n")
def freeze_verdicts_of_changed_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _layers(spark, sf_dir)
    done = rewrite.frozen(made).join(made.select("path", F.col("text").alias("old")), "path")
    more = lambda what: F.replace("text", F.lit("        asset inputs"), F.concat(F.lit(what), F.lit("        asset inputs")))
    text = F.when(_number() % 5 == 1, F.col("old")).when(_number() % 5 == 2, F.replace("text", F.lit("visibility.timeSamples"), F.lit("visibility")))
    text = text.when(_number() % 5 == 3, more("        matrix4d xformOp:transform.timeSamples = {\n        }\n")).when(_number() % 5 == 4, more("        token visibility.timeSamples = {\n        }\n")).otherwise(F.col("text"))
    found = rules.verdict(rules.freeze_checks(made, done.select("path", text.alias("text"))))
    return found.select("path", F.array_join("problems", "|").alias("problems"), "ok")


#: Layers of which some have a matrix, a zero scale, visibility, or slow time codes; one in ten has a camera as it is.
@_query(
    f"with {_K}, m as (select path, cam, user_id % 6 u, count(distinct v) > 1 moves, count(*) filter (v < 1e-9) zero from k join n using (user_id) group by path, cam, user_id) "
    "select path, 'no moving translate' \"check\", not moves ok, moves::int::varchar detail from m union all select path, 'no matrix samples', u <> 1, (u = 1)::int::varchar from m union all select path, 'no zero scale', zero = 0 and u <> 2, (zero + (u = 2)::int)::varchar from m "
    "union all select path, 'no cameras or lights', not cam, cam::int::varchar from m union all select path, 'visibility', true, case when u = 3 then '' else 'none' end from m union all select path, 'short time codes', u not in (4, 5), case u when 4 then '5.0' when 5 then '0.0' else '24.0' end from m"
)
def layer_checks_of_changed_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = lambda what: F.replace("text", F.lit("        asset inputs"), F.concat(F.lit(what), F.lit("        asset inputs")))
    case = _number() % 6
    text = F.when(case == 1, put("        matrix4d xformOp:transform.timeSamples = {\n        }\n")).when(case == 2, F.replace("text", F.lit("xformOp:scale.timeSamples = {\n"), F.lit("xformOp:scale.timeSamples = {\n            40: (0, 0, 0),\n")))
    text = text.when(case == 3, put("        token visibility.timeSamples = {\n        }\n")).when(case == 4, F.replace("text", F.lit("PerSecond = 24"), F.lit("PerSecond = 5"))).when(case == 5, F.replace("text", F.lit("    timeCodesPerSecond = 24\n"), F.lit("")))
    return rules.layer_checks(_layers(spark, sf_dir).select("path", text.otherwise(F.col("text")).alias("text")))


_CHANGED = ORACLES["layer_checks_of_changed_layers"]


@_query(f"with r as ({_CHANGED}), t as (select path, ok, case when ok then 'ok   ' else 'FAIL ' end || \"check\" || case when detail = '' then '' else ': ' || detail end line from r) select path, string_agg(line, chr(10) order by line) || chr(10) || case when bool_and(ok) then 'passed' else 'failed' end \"value\" from t group by path")
def layer_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report(layer_checks_of_changed_layers(spark, sf_dir))


@_query(f"with {_K} select path, 'with' how, 'Camera' kind, 'cam' \"name\" from n where cam union all select path, 'without', 'Mesh', path from n")
def typed_prims(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = layers.lines(_layers(spark, sf_dir))
    told = lambda how, df: df.select("path", F.lit(how).alias("how"), "kind", "name")
    return told("with", layers.prims(numbered, rules.LEAKED_KINDS)).unionByName(told("without", layers.prims(numbered, without=["Xform", *rules.LEAKED_KINDS])))


#: Containers of parts: sound ones, some not aligned, some with a changed byte, some that say they are compressed.
@_query("select 'p' || p_partkey path, p_partkey % 4 = 0 ok, ['', 'aligned', 'intact', 'stored'][1 + p_partkey % 4] problems from part")
def container_verdicts_of_damaged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("p"), "p_partkey").alias("package"), F.lit(0).alias("place"), F.lit("root.usda").alias("name"), F.encode("p_name", "UTF-8").alias("data"))
    files = lambda odd: part.filter(f"p_partkey % 4 {'=' if odd else '<>'} 1").drop("p_partkey")
    made = containers.packages(files(False)).unionByName(containers.packages(files(True), unit=1))
    case = F.substring("package", 2, 20).cast("long") % 4
    # payloads start at byte 64; the method stands at byte 8 of an entry
    content = F.when(case == 2, F.overlay("content", F.lit(b"\xff"), F.lit(65), F.lit(1))).when(case == 3, F.overlay("content", F.lit(b"\x08\x00"), F.lit(9), F.lit(2))).otherwise(F.col("content"))
    found = rules.verdict(rules.packaging(containers.container_entries(made.select(F.col("package").alias("path"), content.alias("content")))))
    return found.select("path", "ok", F.array_join("problems", "|").alias("problems"))


@_query("select 'p' || p_partkey // 2 path, case when sum(p_size) * 400000 > 25 * 1048576 then 'large' else '' end detail from part group by p_partkey // 2")
def package_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.floor(F.col("p_partkey") / 2)).alias("path"), F.lit("x").alias("name"), F.lit(0).alias("method"), F.lit(64).cast("long").alias("data_off"), (F.col("p_size").cast("long") * 400000).alias("size"), F.lit(0).cast("long").alias("crc"), F.lit(True).alias("crc_ok"))
    return rules.packaging(entries).filter("check = 'size'").select("path", "detail")


@_query("with p as (select l_orderkey path, l_partkey % 50 a, l_partkey % 50 + l_quantity::int % 7 b, l_linenumber n, l_suppkey s from lineitem), o as (select path, a, b, max(b) over (partition by path order by a, b, n, s rows between unbounded preceding and 1 preceding) m from p) select path, a \"start\", b stop, m \"before\" from o where a < m")
def patch_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_partkey") % 50
    patches = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), start.alias("start"), (start + F.col("l_quantity").cast("int") % 7).alias("stop"))
    return rewrite.overlaps(patches)


@_query("with e as (select vec_id, label, embedding[1]::double x, embedding[2]::double y, embedding[3]::double z from embeddings), m as (select label, avg(x) x, avg(y) y, avg(z) z from e group by label) select vec_id, round(e.x - m.x, 6) + 0.0 x, round(e.y - m.y, 6) + 0.0 y, round(e.z - m.z, 6) + 0.0 z, round(label + m.x, 6) + 0.0 at_x from e join m using (label)")
def centred_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _table(spark, sf_dir, "embeddings").select("vec_id", "label", _doubles("embedding").alias("e"))
    vertices = held.select(F.col("label").alias("object"), F.col("vec_id").alias("idx"), *[F.col("e")[i].alias(c) for i, c in enumerate("xyz")])
    objects = held.select(F.col("label").alias("name"), F.lit(None).cast("string").alias("parent"), F.array(F.col("label").cast("double"), F.lit(0.0), F.lit(0.0)).alias("loc")).distinct()
    moved, placed = geometry.origin_to_centroid(vertices, objects)
    both = moved.join(placed.select(F.col("name").alias("object"), F.col("loc")[0].alias("at_x")), "object")
    return both.select(F.col("idx").alias("vec_id"), *[(_rounded(c) + 0.0).alias(c) for c in "xyz"], (_rounded("at_x") + 0.0).alias("at_x"))


_LERP = "u as (select user_id, d::double f, v, lead(d) over w::double b, lead(v) over w vb from k window w as (partition by user_id order by d)), e as (select user_id, min(f) k0, max(f) k1, min_by(v, f) v0, max_by(v, f) v1 from u group by user_id), g as (select range::double f from range(1, 32)), m as (select e.user_id, g.f, case when g.f <= k0 then v0 when g.f >= k1 then v1 else u.v + (u.vb - u.v) * (g.f - u.f) / (u.b - u.f) end v from e cross join g left join u on u.user_id = e.user_id and u.f <= g.f and g.f < u.b)"


@_query(f"with {_K}, {_LERP}, c as (select 's' || user_id % 40 path, f::int frame, count(*) filter (v > 100) n from m group by user_id % 40, f) select path, frame, n from c where n <> 1")
def layer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.layer_coverage(_layers(spark, sf_dir), level=100.0, scene=F.concat(F.lit("s"), _number() % 40))


@_query(f"with {_K}, {_LERP}, s as (select user_id, f::int f, v > 150 seen from m), c as (select *, lag(seen) over (partition by user_id order by f) p from s) select 'u' || user_id path, f frame, case when seen then 'inherited' else 'invisible' end token from c where p is null or p <> seen")
def seen_above_a_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.visibility(_layers(spark, sf_dir), component="x", level=150.0).select("path", "frame", "token")


@_query(f"with {_K}, m as (select user_id, d, v > 0.5 * max(v) over (partition by user_id) st from k), a as (select user_id, d, st from m union all select user_id, 1, false from k group by user_id having min(d) > 1), l as (select *, lag(st) over (partition by user_id order by d) p from a) select 'u' || user_id path, d::double frame, case when st then 'inherited' else 'invisible' end token, (select count(*) from k where k.user_id = l.user_id) still from l where p is null or p <> st")
def injected_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written once, as three tables are read from it
    done = structure.dealt(kept(rewrite.injected(_layers(spark, sf_dir))))
    numbered = layers.lines(done)
    # the samples of translate are as many as before, and no scale has any
    still = layers.samples(numbered, "xformOp:translate").groupBy("path").agg(F.count(F.lit(1)).alias("still"))
    gone = layers.samples(numbered, "xformOp:scale").select("path").distinct()
    return layers.token_samples(numbered).join(still, "path").join(gone, "path", "left_anti").select("path", "frame", "token", "still")


@_query("with o as (select o_custkey c, count(*) n, count(distinct o_orderkey % 2) kinds from orders group by o_custkey) select 'c' || c path, false exact, kinds > 1 raw from o")
def moving_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as samples of one place, which odd and even ones write in two ways."""
    orders = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("o"))
    each = F.array_join(F.transform("o", lambda k: F.concat(k.cast("string"), F.when(k % 2 == 0, ": (0, 5, 0),\n").otherwise(": (0, 5.0, 0),\n"))), "")
    made = orders.select(F.concat(F.lit("c"), "o_custkey").alias("path"), F.concat(F.lit('def Mesh "m"\n{\ndouble3 xformOp:translate.timeSamples = {\n'), each, F.lit("}\n}\n")).alias("text"))
    made = structure.dealt(made)
    told = lambda digits, name: rules.layer_checks(made, digits=digits).filter("check = 'no moving translate'").select("path", (~F.col("ok")).alias(name))
    return told(None, "exact").join(told("raw", "raw"), "path")
