"""Queries over the plain tables, each through an operator of the library, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinotable.functions import columns as C
from kinotable.operators import attribution, geometry, rewrite, rules, selection, timeline
from kinotable.plans import keys as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str) -> Callable:
    def held(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return held


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doubles(name: str) -> Column:
    return F.transform(name, lambda x: x.cast("double"))


def _rounded(v) -> Column:
    return F.round(v, 6)


_FRAME = "cast(dayofyear(ts) as double) + cast(hour(ts) as double) / 24"
_SAMPLES = f"select user_id, f, max(value) v from (select user_id, {_FRAME} f, value from events) group by user_id, f"
_STATE = "select user_id, ts, event_id, value > 0.5 * max(value) over (partition by user_id) st from events"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.dayofyear("ts").cast("double") + F.hour("ts").cast("double") / 24
    return _table(spark, sf_dir, "events").groupBy("user_id", frame.alias("f")).agg(F.max("value").alias("v"))


@_query("select a.event_id, b.event_id p from (select * from events where event_type = 'click') a asof left join (select * from events where event_type = 'purchase') b on a.user_id = b.user_id and a.ts >= b.ts")
def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    left, right = events.filter("event_type = 'click'").drop("event_type"), events.filter("event_type = 'purchase'")
    return attribution.asof_join(left, right, ["user_id"], "ts", "event_id", "p", F.to_date("ts"), tie="event_id").select("event_id", "p")


@_query("select event_id, coalesce(last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), -1) owner from events")
def nearest_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    mark = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return attribution.preceding(events, ["user_id"], ["ts", "event_id"], mark, "owner", F.lit(-1).cast("long")).select("event_id", "owner")


@_query(f"with m as ({_STATE}), g as (select *, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, st order by ts, event_id) grp from m) select user_id, min(event_id) first_event, count(*) n from g where st group by user_id, grp")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    on = timeline.switched(events, ["user_id"], F.col("value"))
    return timeline.islands(events, ["user_id"], ["ts", "event_id"], on, [F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n")])


@_query(f"with m as ({_STATE}), l as (select *, lag(st) over (partition by user_id order by ts, event_id) p from m) select user_id, event_id, case when st then 'inherited' else 'invisible' end as token from l where p is null or p <> st")
def runchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    token = F.when(timeline.switched(events, ["user_id"], F.col("value")), "inherited").otherwise("invisible")
    return timeline.changes(events.withColumn("on", token), ["user_id"], ["ts", "event_id"], F.col("on")).select("user_id", "event_id", F.col("state").alias("token"))


@_query(f"with u as ({_SAMPLES}), seg as (select user_id, f a, v va, lead(f) over (partition by user_id order by f) b, lead(v) over (partition by user_id order by f) vb from u), e as (select user_id, min(a) k0, max(a) k1, min_by(va, a) v0, max_by(va, a) v1 from seg group by user_id), g as (select cast(range as double) f from range(1, 31)) select user_id, f, round(case when f <= k0 then v0 when f >= k1 then v1 else va + (vb - va) * (f - a) / (b - a) end, 6) val from (select e.user_id, k0, k1, v0, v1, g.f, a, va, b, vb from e cross join g left join seg on seg.user_id = e.user_id and seg.a <= g.f and g.f < seg.b and g.f > e.k0 and g.f < e.k1)")
def lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _samples(spark, sf_dir)
    frames = known.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(1), F.lit(30)).cast("array<double>")).alias("f"))
    return timeline.evaluated(known, frames, ["user_id"], "f", "v").select("user_id", "f", _rounded("v").alias("val"))


@_query(f"with u as ({_SAMPLES}), n as (select *, lead(f) over (partition by user_id order by f) next_frame, lead(v) over (partition by user_id order by f) next_value from u) select user_id, round(f, 6) f, round(next_frame, 6) next_frame, v, next_value from n where (v > 50) <> (next_value > 50) and abs(next_frame - f - 1) > 1e-9")
def slow_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.slow_transitions(_samples(spark, sf_dir), ["user_id"], "f", "v", 50.0)
    return found.select("user_id", _rounded("f").alias("f"), _rounded("next_frame").alias("next_frame"), "v", "next_value")


@_query(f"with u as ({_SAMPLES}) select user_id, round(min(case when v > 100 then f end), 6) first_on, round(max(case when v > 100 then f end), 6) last_on from u group by user_id")
def on_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.on_windows(_samples(spark, sf_dir), ["user_id"], "f", F.col("v") > 100)
    return found.select("user_id", _rounded("first_on").alias("first_on"), _rounded("last_on").alias("last_on"))


@_query("select g.range as \"day\", count(e.event_id) n from range(1, 32) g left join (select event_id, dayofyear(ts) d from events where value > 100) e on e.d = g.range group by g.range having count(e.event_id) <> 1")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.dayofyear("ts").cast("long").alias("day"), "value")
    return timeline.coverage(events, spark.range(1, 32).withColumnRenamed("id", "day"), "day", F.col("value") > 100)


@_query("with b as (select distinct user_id, dayofyear(ts) frame from events where value > 100), g as (select *, frame - row_number() over (partition by user_id order by frame) r from b) select user_id, min(frame) \"start\", max(frame) stop from g group by user_id, r")
def frame_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("user_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = _table(spark, sf_dir, "events").filter("value > 100").select("user_id", F.dayofyear("ts").alias("frame"))
    return timeline.frame_islands(on, ["user_id"], "frame")


_BLOCKS = ORACLES["frame_blocks"].replace('"start"', "a").replace("stop", "b")


@_query(f"with b as (select * from ({_BLOCKS.replace('with b as', 'with b0 as').replace('from b)', 'from b0)')})), k as (select user_id, a frame, 1.0 v from b union select user_id, b, 1.0 from b union select user_id, a - 1, 0.0 from b where a - 1 between 1 and 31 union select user_id, b + 1, 0.0 from b where b + 1 between 1 and 31 union select user_id, 1, 0.0 from b union select user_id, 31, 0.0 from b) select user_id, cast(frame as int) frame, cast(max(v) as double) \"value\" from k group by user_id, frame")
def regenerated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.regenerated_keys(_blocks(spark, sf_dir), ["user_id"], 1, 31)


@_query(f"with b as (select * from ({_BLOCKS.replace('with b as', 'with b0 as').replace('from b)', 'from b0)')})), k as (select user_id, a frame, 2 p, false h from b union all select user_id, b + 1, 1, true from b where b + 1 <= 31 union all select distinct user_id, 1, 0, true from b) select user_id, cast(frame as int) frame, max_by(h, p) \"hidden\" from k group by user_id, frame")
def hide_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.hide_keys(_blocks(spark, sf_dir), ["user_id"], 1, 31)


@_query("with o as (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) - 1 i, 240.0::double / count(*) over (partition by c_nationkey) span from customer) select c_nationkey, c_custkey, cast(round_even(1 + i * span, 0) as int) \"start\", least(cast(round_even(1 + (i + 1) * span, 0) as int) - 1, 240) stop from o")
def even_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.even_windows(_table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], 1, 240)


@_query("with e as (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 i from embeddings) select label, cast(i as int) axis, round(avg(x), 6) + 0.0 centroid from e group by label, i")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.centroids(_table(spark, sf_dir, "embeddings"), ["label"], _doubles("embedding"))
    return found.select("label", F.posexplode("centroid").alias("axis", "x")).select("label", "axis", (_rounded("x") + 0.0).alias("centroid"))


_RADII = "with e as (select label, vec_id, unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings), c as (select label, i, avg(x) c from e group by label, i), d as (select label, vec_id, sqrt(sum(pow(x - c, 2))) d from e join c using (label, i) group by label, vec_id), r as (select label, max(d) radius from d group by label), o as (select label, sqrt(sum(c * c)) away from c group by label) "


@_query(_RADII + "select label, round(radius, 6) radius from r")
def radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.radii(_table(spark, sf_dir, "embeddings"), ["label"], _doubles("embedding")).select("label", _rounded("radius").alias("radius"))


@_query(_RADII + "select label, case when away / radius >= 2 then 'guilty' when away / radius >= 0.5 then 'caution' else 'ok' end verdict from r join o using (label)")
def origin_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.radii(_table(spark, sf_dir, "embeddings"), ["label"], _doubles("embedding"))
    return found.select("label", rules.origin_verdict(C.norm(F.col("centroid")), F.col("radius")).alias("verdict"))


@_query("with e as (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 i from embeddings) select label, cast(i as int) axis, round(min(x), 6) lo, round(max(x), 6) hi from e group by label, i")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.bounds(_table(spark, sf_dir, "embeddings"), ["label"], _doubles("embedding"))
    return found.select("label", F.posexplode(F.arrays_zip("lo", "hi")).alias("axis", "b")).select("label", "axis", _rounded("b.lo").alias("lo"), _rounded("b.hi").alias("hi"))


@_query("select label, round(max(sqrt(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: power(z[1]::double - z[2]::double, 2))))), 6) diameter from embeddings x join embeddings y using (label) where x.vec_id < y.vec_id group by label")
def diameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.diameters(_table(spark, sf_dir, "embeddings"), ["label"], F.col("embedding")).select("label", _rounded("diameter").alias("diameter"))


@_query("select c_nationkey, coalesce(max(case when substr(lo, 1, i) = substr(hi, 1, i) then substr(lo, 1, i) end), '') prefix from (select c_nationkey, min(c_name) lo, max(c_name) hi from customer group by c_nationkey), (select range i from range(1, 64)) group by c_nationkey")
def common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.common_prefix(_table(spark, sf_dir, "customer"), "c_name", ["c_nationkey"])


@_query("select p_brand, list_reduce(list(distinct cast(p_size as bigint) * 6), lambda a, b: gcd(a, b)) divisor from part where p_size > 0 group by p_brand")
def common_divisor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.common_divisor(_table(spark, sf_dir, "part"), ["p_brand"], F.col("p_size") * 6)


@_query("select user_id, count(distinct value) n_values, min(value) lo, max(value) hi from events group by user_id having count(distinct value) > 1")
def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.moving(_table(spark, sf_dir, "events"), ["user_id"], F.array("value"))
    return found.select("user_id", "n_values", F.col("lo")[0].alias("lo"), F.col("hi")[0].alias("hi"))


@_query("select p_brand, n, array_to_string(list_slice(names, 1, 4), '|') names from (select p_brand, count(*) n, list(p_name order by p_retailprice desc, p_name) names from part group by p_brand)")
def by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.by_kind(_table(spark, sf_dir, "part"), "p_brand", "p_name", F.desc("p_retailprice"))
    return found.select("p_brand", "n", F.array_join("names", "|").alias("names"))


@_query("select p_partkey, p_name from part where upper(p_name) like '%RING%' or upper(p_name) like '%WIDGET%'")
def any_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").filter(C.contains_any(F.col("p_name"), ["ring", "widget"], "fold")).select("p_partkey", "p_name")


@_query("select page_id, nullif(regexp_extract(html, '<title>([^<]+)</title>', 1), '') title from pages")
def meta_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", C.first_match(F.col("html"), "<title>([^<]+)</title>").alias("title"))


@_query("with p as (select page_id, html, instr(html, '<title>') a, instr(html, '</title>') b from pages) select page_id, md5(case when a > 0 and b > a then substr(html, 1, a + 6) || '[' || substr(html, a + 7, b - a - 7) || ']' || substr(html, b) else html end) digest from p")
def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("text"))
    a, b = F.instr("text", "<title>"), F.instr("text", "</title>")
    title = F.substring("text", F.col("a") + 7, F.col("b") - F.col("a") - 7)
    patches = layers.withColumn("a", a).withColumn("b", b).filter("a > 0 and b > a").select("path", (F.col("a") + 6).alias("start"), (F.col("b") - 1).alias("stop"), F.concat(F.lit("["), title, F.lit("]")).alias("repl"))
    return rewrite.apply_patches(layers, patches).select(F.col("path").alias("page_id"), F.md5("text").alias("digest"))


@_query("select s_nationkey, round(max(s_acctbal) - min(s_acctbal), 6) travel, case when stddev_pop(s_acctbal) > 3000 * 0.1 and max(s_acctbal) - min(s_acctbal) > 300 then 'spread' when max(s_acctbal) - min(s_acctbal) > 60 then 'moving' else 'ok' end verdict from supplier group by s_nationkey")
def spread_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg((F.max("s_acctbal") - F.min("s_acctbal")).alias("travel"), F.stddev_pop("s_acctbal").alias("radius"))
    wide = F.when(F.col("travel") > 300, F.col("radius")).otherwise(F.lit(0.0))
    return held.select("s_nationkey", _rounded("travel").alias("travel"), rules.spread_verdict(F.col("travel"), wide, F.lit(3000.0)).alias("verdict"))


@_query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinotable.sources.layers import present_and_missing

    there = _table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return present_and_missing(_table(spark, sf_dir, "customer").select("c_custkey"), there, "c_custkey")[1]


@_query("with t as (select user_id, cast(min(dayofyear(ts)) as double) a, cast(max(dayofyear(ts)) as double) b from events group by user_id) select distinct user_id, round(a + (b - a) * k, 6) f from t, (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double k)")
def quarter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.dayofyear("ts")).cast("double").alias("a"), F.max(F.dayofyear("ts")).cast("double").alias("b"))
    return ends.select("user_id", F.explode(selection.quarter_points(F.col("a"), F.col("b"))).alias("f")).select("user_id", _rounded("f").alias("f"))
