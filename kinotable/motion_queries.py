"""Queries over keyed motion: curves by mode, boxes under full transforms and their worst frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinotable.operators import curves, geometry
from kinotable.queries import _query, _rounded
from kinotable.scene_queries import _K, _days

#: A user's days as samples whose mode goes by the day; a cubic's handles lie a third of the way, the value of the first handle twice that of its sample.
_CURVES = (
    f"{_K}, u as (select user_id, d::double f, v, lead(d) over w::double b, lead(v) over w vb, ['CONSTANT', 'LINEAR', 'BEZIER'][1 + d % 3] mode from k window w as (partition by user_id order by d)), "
    "e as (select user_id, min(f) k0, max(f) k1, min_by(v, f) v0, max_by(v, f) v1 from u group by user_id), g as (select range / 2 f from range(2, 63))"
)


@_query(
    f"with {_CURVES}, x as (select e.user_id, g.f as ask, k0, k1, v0, v1, u.* exclude (user_id) from e cross join g left join u on u.user_id = e.user_id and u.f <= g.f and g.f < u.b), y as (select *, (ask - f) / (b - f) t from x) "
    "select user_id, ask f, round(case when ask <= k0 then v0 when ask >= k1 then v1 when mode = 'CONSTANT' then v when mode = 'LINEAR' then v + (vb - v) * t else pow(1 - t, 3) * v + 3 * pow(1 - t, 2) * t * 2 * v + 3 * (1 - t) * t * t * (vb - 10) + pow(t, 3) * vb end, 6) val from y"
)
def curves_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir).withColumn("d", F.col("d").cast("double"))
    order = Window.partitionBy("user_id").orderBy("d")
    third = lambda other, share: F.col("d") + (other - F.col("d")) * share / 3
    right = F.struct(third(F.lead("d").over(order), 1).alias("f"), (F.col("v") * 2).alias("v"))
    left = F.struct(third(F.lag("d").over(order), 1).alias("f"), (F.col("v") - 10).alias("v"))
    mode = F.element_at(F.array(*map(F.lit, ("CONSTANT", "LINEAR", "BEZIER"))), (F.col("d") % 3 + 1).cast("int"))
    keyed = days.select("user_id", F.col("d").alias("f"), "v", mode.alias("mode"), right.alias("right"), left.alias("left"))
    frames = days.select("user_id").distinct().select("user_id", F.explode(F.transform(F.sequence(F.lit(2), F.lit(62)), lambda i: i / 2)).alias("f"))
    return curves.evaluated_by_mode(keyed, frames, ["user_id"], "f", "v", "mode").select("user_id", "f", _rounded("v").alias("val"))


#: A box for each user, moved and stretched by its days, turned about the third axis at three frames.
_POSES = (
    f"{_K}, u as (select user_id, d::double f, v, lead(d) over w::double b, lead(v) over w vb from k window w as (partition by user_id order by d)), e as (select user_id, min(f) k0, max(f) k1, min_by(v, f) v0, max_by(v, f) v1 from u group by user_id), "
    "g as (select unnest([1.0, 8.5, 16.0, 23.5, 31.0])::double f), m as (select e.user_id, g.f, case when g.f <= k0 then v0 when g.f >= k1 then v1 else u.v + (u.vb - u.v) * (g.f - u.f) / (u.b - u.f) end v from e cross join g left join u on u.user_id = e.user_id and u.f <= g.f and g.f < u.b), "
    "h as (select *, case when f < 11 then 1 else 11 end a, case when f < 11 then 11 else 31 end b from m), t as (select *, (user_id * a % 7) * 0.9 h1, (user_id * b % 7) * 0.9 h2 from h), "
    "r as (select *, 2 * (h1 + (h2 - h1 - pi() * round((h2 - h1) / pi())) * (f - a) / (b - a)) angle, 1 + v / 500 sx, (user_id % 3 + 1)::double y from t), "
    "p as (select user_id, f frame, v + least(0, cos(angle) * sx, -sin(angle) * y, cos(angle) * sx - sin(angle) * y) lo0, v + greatest(0, cos(angle) * sx, -sin(angle) * y, cos(angle) * sx - sin(angle) * y) hi0, least(0, sin(angle) * sx, cos(angle) * y, sin(angle) * sx + cos(angle) * y) lo1, greatest(0, sin(angle) * sx, cos(angle) * y, sin(angle) * sx + cos(angle) * y) hi1, -v / 2 lo2, 2 - v / 2 hi2 from r)"
)


def _posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir).withColumn("frame", F.col("d").cast("double"))
    users = days.select("user_id").distinct()
    zero = F.lit(0.0)
    boxes = users.select("user_id", F.array(zero, zero, zero).alias("lo"), F.array(F.lit(1.0), (F.col("user_id") % 3 + 1).cast("double"), F.lit(2.0)).alias("hi"))
    frames = users.select("user_id", F.explode(F.array(*map(F.lit, (1.0, 8.5, 16.0, 23.5, 31.0)))).alias("frame"))
    location = days.select("user_id", "frame", F.array("v", zero, -F.col("v") / 2).alias("value"))
    scale = days.select("user_id", "frame", F.array(1 + F.col("v") / 500, F.lit(1.0), F.lit(1.0)).alias("value"))
    half = (F.col("user_id") * F.col("frame") % 7) * 0.9
    rotation = users.select("user_id", F.explode(F.array(*map(F.lit, (1.0, 11.0, 31.0)))).alias("frame")).select("user_id", "frame", F.array(F.cos(half), zero, zero, F.sin(half)).alias("value"))
    return geometry.posed_boxes(boxes, frames, ["user_id"], location, rotation, scale)


@_query(f"with {_POSES} select user_id, frame, round(lo0, 6) + 0.0 lo0, round(hi0, 6) + 0.0 hi0, round(lo1, 6) + 0.0 lo1, round(hi1, 6) + 0.0 hi1, round(lo2, 6) + 0.0 lo2, round(hi2, 6) + 0.0 hi2 from p")
def posed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posed(spark, sf_dir).select("user_id", "frame", *[(_rounded(F.col(side)[k]) + 0.0).alias(f"{side}{k}") for k in range(3) for side in ("lo", "hi")])


@_query(f"with {_POSES}, s as (select user_id % 10 scene, frame, sqrt(pow(min(lo0) + max(hi0), 2) + pow(min(lo1) + max(hi1), 2) + pow(min(lo2) + max(hi2), 2)) / 2 away from p group by user_id % 10, frame) select scene, max_by(frame, away) frame, round(max(away), 6) away from s group by scene")
def worst_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = geometry.united(_posed(spark, sf_dir).withColumn("scene", F.col("user_id") % 10), ["scene", "frame"])
    return geometry.worst_frames(whole, ["scene"]).select("scene", "frame", _rounded("away").alias("away"))
