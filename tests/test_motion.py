"""Curves, poses and the stream of verdicts beside plain versions."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from kinotable.operators import curves, geometry
from kinotable.streaming.flips import watch_flips
from kinotable.streaming.layers import watch

SAMPLE = "k string, f double, v double, mode string, right struct<f:double,v:double>, left struct<f:double,v:double>"


def plain_curve(samples, at):
    samples = sorted(samples)
    if at <= samples[0][0]:
        return samples[0][1]
    if at >= samples[-1][0]:
        return samples[-1][1]
    a, b = next((x, y) for x, y in zip(samples, samples[1:]) if x[0] <= at < y[0])
    if a[2] == "CONSTANT" or a[0] == at:
        return a[1]
    t = (at - a[0]) / (b[0] - a[0])
    if a[2] == "BEZIER":
        p = np.array([a[:2], a[3] or (a[0] + (b[0] - a[0]) / 3, a[1] + (b[1] - a[1]) / 3), b[4] or (a[0] + (b[0] - a[0]) * 2 / 3, a[1] + (b[1] - a[1]) * 2 / 3), b[:2]], float)
        x = p[:, 0]
        # t by the roots of the time equation
        roots = np.roots([-x[0] + 3 * x[1] - 3 * x[2] + x[3], 3 * x[0] - 6 * x[1] + 3 * x[2], 3 * (x[1] - x[0]), x[0] - at])
        t = next(r.real for r in roots if abs(r.imag) < 1e-7 and -1e-9 <= r.real <= 1 + 1e-9)
        return float(((1 - t) ** 3) * p[0, 1] + 3 * (1 - t) ** 2 * t * p[1, 1] + 3 * (1 - t) * t * t * p[2, 1] + t**3 * p[3, 1])
    return a[1] + (b[1] - a[1]) * t


def test_curves_by_mode(spark):
    rng = np.random.default_rng(1)
    rows, frames = [], []
    for k in "abcd":
        at = np.sort(rng.choice(np.arange(40), 8, replace=False)).astype(float)
        for i, f in enumerate(at):
            right = (f + rng.uniform(0, 1) * (at[i + 1] - f), rng.normal()) if i < 7 and rng.random() < 0.8 else None
            left = (f - rng.uniform(0, 1) * (f - at[i - 1]), rng.normal()) if i and rng.random() < 0.8 else None
            rows.append((k, float(f), float(rng.normal()), str(rng.choice(["CONSTANT", "LINEAR", "BEZIER"])), tuple(map(float, right)) if right else None, tuple(map(float, left)) if left else None))
        frames += [(k, float(x)) for x in np.arange(-2, 43, 0.5)]
    asked = spark.createDataFrame(frames, "k string, f double")
    got = {(r.k, r.f): r.v for r in curves.evaluated_by_mode(spark.createDataFrame(rows, SAMPLE), asked, ["k"], "f", "v", "mode").collect()}
    assert len(got) == len(frames)
    for (k, f), v in got.items():
        assert v == pytest.approx(plain_curve([r[1:] for r in rows if r[0] == k], f), abs=1e-6)
    for bad in ("CUBIC", None):
        wrong = spark.createDataFrame([("a", 0.0, 1.0, bad, None, None), ("a", 9.0, 1.0, bad, None, None)], SAMPLE)
        with pytest.raises(PySparkException, match="no such mode"):
            curves.evaluated_by_mode(wrong, asked, ["k"], "f", "v", "mode").collect()


def test_rotations_go_the_shorter_way(spark):
    half = np.array([0.0, 1.2, 2.9, 2.9, 6.0])
    rows = [("a", float(i), [float(s * np.cos(h)), 0.0, float(s * np.sin(h)), 0.0]) for i, (h, s) in enumerate(zip(half, (1, -3, 1, 1, 0.5)))]
    frames = [("a", x / 4) for x in range(-4, 24)]
    got = {r.frame: np.array(r.value) for r in curves.evaluated_rotations(spark.createDataFrame(rows, "k string, frame double, value array<double>"), spark.createDataFrame(frames, "k string, frame double"), ["k"]).collect()}
    for _, f in frames:
        i = int(np.clip(np.floor(f), 0, 3))
        t = np.clip(f - i, 0, 1)
        step = half[i + 1] - half[i]
        h = half[i] + t * (step - np.pi * np.round(step / np.pi))
        assert abs(abs(got[f] @ np.array([np.cos(h), 0, np.sin(h), 0])) - 1) < 1e-9 and np.isclose(np.linalg.norm(got[f]), 1)


def test_poses_without_channels_and_null_boxes(spark):
    boxes = spark.createDataFrame([("a", [0.0, 0.0, 0.0], [1.0, 2.0, 3.0]), ("b", None, None), ("c", [1.0, 1.0, 1.0], [2.0, 2.0, 2.0])], "k string, lo array<double>, hi array<double>")
    frames = spark.createDataFrame([(k, f) for k in "abc" for f in (1.0, 2.0)], "k string, frame double")
    turn = spark.createDataFrame([("a", 1.0, [1.0, 0.0, 0.0, 1.0])], "k string, frame double, value array<double>")
    got = {(r.k, r.frame): (r.lo, r.hi) for r in geometry.posed_boxes(boxes, frames, ["k"], rotation=turn).collect()}
    assert np.allclose(got["a", 2.0], ([-2, 0, 0], [0, 1, 3])) and got["b", 1.0] == (None, None) and got["c", 1.0] == ([1.0] * 3, [2.0] * 3)
    worst = {r.k: (r.frame, r.away) for r in geometry.worst_frames(geometry.posed_boxes(boxes, frames, ["k"]), ["k"]).collect()}
    assert worst == {"a": (1.0, pytest.approx(np.sqrt(14) / 2)), "c": (1.0, pytest.approx(np.sqrt(27) / 2))}


def test_only_flips_are_told_over_a_restart(spark, tmp_path):
    head = "#usda 1.0\n(\n    timeCodesPerSecond = 24\n)\n"
    good, bad = head + 'def Mesh "a"\n{\n}\n', head + 'def Mesh "a"\n{\n    float3 xformOp:scale.timeSamples = {\n        1: (0, 0, 0),\n    }\n}\n'
    place = lambda name: str(tmp_path / name)

    def delivered(n, **texts):
        (tmp_path / "in" / f"v{n}").mkdir(parents=True)
        for name, text in texts.items():
            (tmp_path / "in" / f"v{n}" / f"{name}.usda").write_text(text)
        # each call starts both queries anew from their checkpoints
        for start in (lambda: watch(spark, f"{place('in')}/*", place("verdicts"), place("c1")), lambda: watch_flips(spark, place("verdicts"), place("flips"), place("c2"))):
            query = start()
            assert query.awaitTermination(120) and query.exception() is None
        return sorted((r.layer, r.batch, r.before, r.ok) for r in spark.read.parquet(place("flips")).collect())

    assert delivered(1, a=good, b=bad) == [("a.usda", 0, None, True), ("b.usda", 0, None, False)]
    assert len(delivered(2, a=good, b=good)) == 3
    assert delivered(3, a=bad, b=good) == [("a.usda", 0, None, True), ("a.usda", 2, True, False), ("b.usda", 0, None, False), ("b.usda", 1, False, True)]


@pytest.mark.parametrize("axes", [1, 2, 3, 6])
def test_diameters_are_those_of_all_pairs(spark, axes):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(axes)
    sets = {"round": rng.normal(size=(150, axes)), "far": rng.normal(size=(80, axes)) + 1e6, "one": rng.normal(size=(1, axes)), "same": np.ones((5, axes)), "line": np.outer(np.arange(40.0), np.ones(axes))}
    table = spark.createDataFrame([(k, p.tolist()) for k, ps in sets.items() for p in ps], "k string, p array<double>")
    got = {r.k: r.diameter for r in geometry.diameters(table, ["k"], F.col("p")).collect()}
    want = {k: float(np.sqrt(((ps[:, None] - ps[None]) ** 2).sum(2)).max()) for k, ps in sets.items()}
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("axes", [3, 8])
def test_diameters_over_many_blocks_are_those_of_all_pairs(spark, axes):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(axes)
    flat = rng.normal(size=(700, axes))
    sets = {"round": flat / np.sqrt((flat**2).sum(1))[:, None], "cube": rng.uniform(size=(300, axes)) + 1e3}
    table = spark.createDataFrame([(k, p.tolist()) for k, ps in sets.items() for p in ps], "k string, p array<double>")
    got = {r.k: r.diameter for r in geometry.diameters(table, ["k"], F.col("p"), block=32).collect()}
    want = {k: float(np.sqrt(((ps[:, None] - ps[None]) ** 2).sum(2)).max()) for k, ps in sets.items()}
    assert got == pytest.approx(want, rel=1e-12)
