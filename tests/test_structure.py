"""Trees of objects and of definitions, beside plain walks."""

import random
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kinotable.operators import hierarchy
from kinotable.operators.prefix import running
from kinotable.registry import QUERIES
from kinotable.sources import layers, structure


def plain_structure(text):
    """For each line: depth before, names of enclosing definitions, the line of its time-sample block."""
    stack, waiting, out, depth = [], {}, [], 0
    for ln, line in enumerate(text.split("\n")):
        change, name, sample = line.count("{") - line.count("}"), re.match(r'\s*def\s+\w+\s+"([^"]+)"', line), "xformOp:scale.timeSamples" in line
        mark = ("def", name[1], ln) if name else ("attr", None, ln) if sample else None
        bare = line.lstrip().startswith("{") or mark
        own = None
        if change > 0:
            own = mark or waiting.get(depth) if bare else None
            if bare:
                waiting.pop(depth, None)
        elif mark:
            waiting[depth] = mark
            if sample and "{" in line:
                waiting.pop(depth)
        around = stack + ([own] + [None] * (change - 1) if change > 0 else [])
        names = [m[1] for m in around if m and m[0] == "def"]
        block = ln if mark and mark[0] == "attr" else around[-1][2] if around and around[-1] and around[-1][0] == "attr" else None
        out.append((ln, depth, names, block))
        depth += change
        stack = around[:depth]
    return out


def made(rng):
    lines = []

    def body(level):
        for i in range(rng.randrange(4)):
            kind = rng.randrange(6)
            if kind == 0 and level < 5:
                lines.append(f'def Mesh "p{len(lines)}"' + rng.choice((" {", "", ' (\n customData = {\n a = 1\n }\n)')))
                if not lines[-1].endswith("{"):
                    lines.append("  {")
                body(level + 1)
                lines.append("}")
            elif kind == 1:
                lines.append("  float3 xformOp:scale.timeSamples = {")
                lines.extend(f"{k}: (1, 1, 1)," for k in range(rng.randrange(3)))
                lines.append("}")
            elif kind == 2:
                lines.extend(["float3 xformOp:scale.timeSamples =", "{", "3: (0, 0, 0) }"])
            elif kind == 3:
                lines.append("float3 xformOp:scale.timeSamples = { 1: (2, 2, 2) }")
            elif kind == 4 and level < 5:
                lines.append('variantSet "v" = {')
                body(level + 1)
                lines.append("}")
            else:
                lines.append("asset a = @x@")

    while len(lines) < 40:
        body(0)
    return "\n".join("\n".join(lines).split("\n"))


@pytest.mark.parametrize("chunk", [None, 1, 7, 1 << 20])
def test_structure_is_that_of_a_plain_walk(spark, chunk):
    rng = random.Random(5)
    texts = [(f"t{i}", made(rng)) for i in range(12)] + [("empty", ""), ("null", None)]
    table = spark.createDataFrame(texts, "path string, text string")
    found = structure.structured(structure.text_lines(table, chunk), r"\QxformOp:scale\E", chunk=chunk).collect()
    got = sorted((r.path, r.ln, r.before, list(r.prims), r.block.ln if r.block else None) for r in found)
    assert got == sorted((p, *x) for p, t in texts if t is not None for x in plain_structure(t))
    old = sorted(map(tuple, layers.lines(table).collect()))
    assert old == sorted(map(tuple, structure.text_lines(table, chunk).drop("at").collect()))


def test_lines_of_a_file_that_is_many_tasks_work(spark, tmp_path):
    rng = random.Random(6)
    texts = {f"f{i}.usda": made(rng) + "\n" * (i % 2) + "é" * i for i in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for chunk in (1, 7, 1 << 16):
            lines = structure.file_lines(spark, str(tmp_path), chunk)
            assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 6
            got = sorted((r.path.rpartition("/")[2], r.ln, r.line, r.before, r.depth, r.at) for r in lines.collect())
            want = []
            for name, text in texts.items():
                at = depth = 0
                for ln, line in enumerate(text.removesuffix("\n").split("\n")):
                    after = depth + line.count("{") - line.count("}")
                    want.append((name, ln, line, depth, after, at))
                    at, depth = at + len(line) + 1, after
            assert got == sorted(want)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_running_values_with_nulls(spark):
    rows = spark.createDataFrame([("a", i, None if i % 3 else i, "x" if i == 5 else None) for i in range(20)] + [(None, 3, 1, None)], "k string, i long, v long, s string")
    for chunk in (None, 1, 6, 100):
        got = {(r.k, r.i): (r.total, r.seen) for r in running(rows, ["k"], "i", {"total": F.col("v")}, {"seen": F.col("s")}, chunk).collect()}
        assert got == {("a", i): (sum(j for j in range(0, i + 1, 3)), "x" if i >= 5 else None) for i in range(20)} | {(None, 3): (1, None)}
        got = {(r.k, r.i): (r.total, r.seen) for r in running(rows, ["k"], "i", {"total": F.col("v")}, {"seen": F.col("s")}, chunk, strict=True).collect()}
        assert got == {("a", i): (sum(j for j in range(0, i, 3)), "x" if i > 5 else None) for i in range(20)} | {(None, 3): (0, None)}


OBJECT = "name string, parent string, location array<double>, rotation array<double>, scale array<double>, delta_location array<double>, parent_inverse array<array<double>>"


def test_worlds_and_taking_out_of_parents(spark):
    rng = np.random.default_rng(7)
    names = [f"o{i}" for i in range(40)]
    parents = [None, "absent"] + [names[int(rng.integers(max(0, i - 3), i))] for i in range(2, 40)]
    rows = []
    for i, (n, p) in enumerate(zip(names, parents)):
        inverse = (np.eye(4) + np.triu(rng.normal(size=(4, 4)), 1)).tolist() if i % 7 == 3 else None
        if inverse:
            inverse[3] = [0.0, 0.0, 0.0, 1.0]
        rows.append((n, p, rng.normal(size=3).tolist(), [0.0] * 4 if i == 5 else rng.normal(size=4).tolist(), rng.uniform(0.5, 2, 3).tolist(), [1.0, 2.0, 3.0] if i % 4 == 1 else None, inverse))

    def local(r, delta=True):
        q = np.array(r[3])
        w, x, y, z = q / np.linalg.norm(q) if np.linalg.norm(q) else (1, 0, 0, 0)
        m = np.eye(4)
        m[:3, :3] = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]) * r[4]
        m[:3, 3] = np.array(r[2]) + (np.array(r[5]) if r[5] else 0)
        return m, np.array(r[6]) if r[6] else np.eye(4)

    by = {r[0]: r for r in rows}

    def world(n):
        m, inv = local(by[n])
        up = by[n][1]
        return (world(up) if up in by else np.eye(4)) @ inv @ m

    table = spark.createDataFrame(rows, OBJECT)
    got = {r.name: np.array(r.world) for r in hierarchy.world_matrices(hierarchy.local_matrices(table)).collect()}
    assert set(got) == set(names) and all(np.allclose(got[n], world(n)) for n in names)
    chosen = F.col("name").isin("o4", "o10", "o17", "o31")
    for unparent in (True, False):
        done = {r.name: r for r in hierarchy.absorbed(table, chosen, unparent).collect()}
        assert all(np.allclose(np.array(r.world), world(n)) for n, r in done.items())
        for n, r in done.items():
            inv = local(by[n])[1] if not (unparent and n in ("o4", "o10", "o17", "o31")) else np.eye(4)
            over = world(r.parent) if r.parent in by else np.eye(4)
            assert np.allclose(over @ inv @ np.array(r.matrix), world(n))
            assert (r.parent is None) == (by[n][1] is None or (unparent and n in ("o4", "o10", "o17", "o31")))
    assert hierarchy.world_matrices(hierarchy.local_matrices(table.limit(0))).count() == 0


def test_cycles_and_doubled_names_are_errors(spark):
    place = ([0.0] * 3, [1.0, 0.0, 0.0, 0.0], [1.0] * 3, None, None)
    for rows, match in (([("a", "b", *place), ("b", "a", *place)], "cycle"), ([("a", None, *place), ("a", None, *place)], "twice")):
        with pytest.raises((ValueError, PySparkException), match=match):
            hierarchy.world_matrices(hierarchy.local_matrices(spark.createDataFrame(rows, OBJECT))).collect()


def test_inverses(spark):
    rng = np.random.default_rng(8)
    ms = [rng.normal(size=(4, 4)) for _ in range(20)] + [np.zeros((4, 4)), np.ones((4, 4))]
    table = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(ms)], "i int, m array<array<double>>")
    got = {r.i: r.v for r in table.select("i", hierarchy.inverse(F.col("m")).alias("v")).collect()}
    assert all(np.allclose(np.array(got[i]), np.linalg.inv(m)) for i, m in enumerate(ms[:20])) and got[20] is None and got[21] is None


def test_dealt_layers_need_no_exchange_of_lines(spark):
    text = 'def Xform "a"\n{\n    double3 xformOp:translate.timeSamples = {\n        1: (0, 0, 0),\n    }\n}\n'
    made = spark.createDataFrame([(f"p{i}", text) for i in range(60)], "path string, text string")
    dealt = structure.dealt(made, (10, 400))
    # twice the layers are twice the tasks
    assert dealt.rdd.getNumPartitions() == -(-60 * len(text) // 400)
    assert structure.dealt(made.limit(30), (10, 400)).rdd.getNumPartitions() == -(-30 * len(text) // 400)
    found = structure.structured(structure.text_lines(dealt), r"\QxformOp:translate\E", levels=2)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert found.filter("block is not null").count() == 180


@pytest.mark.parametrize("name", ["nested_depths", "nested_samples", "layer_coverage", "moving_as_written"])
def test_a_task_takes_no_more_layers_where_there_are_more(spark, monkeypatch, name):
    monkeypatch.setattr(structure.dealt, "__defaults__", ((1 << 20, 1 << 10),))
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    parts = [int(n) for n in re.findall(r"hashpartitioning\(path#\d+, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert parts and min(parts) > 10


def test_injected_layers_are_made_once(spark):
    plan = QUERIES["injected_visibility"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan


def test_files_are_opened_once(spark, tmp_path):
    (tmp_path / "a.txt").write_text("{\n}\n")
    found = structure.file_lines(spark, str(tmp_path))
    assert "FileScan text" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.ln, r.depth) for r in found.orderBy("ln").collect()] == [(0, 1), (1, 0)]
