"""Layers, rewriting, containers, rules and the stream on small texts with hand-made expectations."""

import io
import random
import zipfile

import pytest
from pyspark.errors import PySparkException

from kinotable.functions.columns import general
from kinotable.operators import geometry, rewrite, rules
from kinotable.plans import modes
from kinotable.sources import containers, layers, sinks
from kinotable.streaming.layers import watch

TEXT = """#usda 1.0
(
    startTimeCode = 1
    endTimeCode = 6
    timeCodesPerSecond = 24
    upAxis = "Y"
)
def Xform "root"
{
    def Mesh "산소"
    {
        float3 xformOp:scale.timeSamples = {
            1: (0, 0, 0),
            3: (1, 1, 1), 5: (1, 1, 1),
            6: (0, 0, 0),
        }
        double3 xformOp:translate.timeSamples = {
            1: (0, 0, 0),
            4: (2.5, 0, 1),
        }
    }
    asset inputs:file = @tex/a.png@
}
"""

FROZEN = """        float3 xformOp:scale = (1, 1, 1)
        token visibility.timeSamples = {
            1: "invisible",
            3: "inherited",
            6: "invisible",
        }
        double3 xformOp:translate = (0, 0, 0)
"""


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([("a.usda", TEXT), ("b.usda", ""), ("c.usda", None)], "path string, text string")


def test_parsing(table):
    numbered = layers.lines(table)
    assert [(r.kind, r.name) for r in layers.prims(numbered).orderBy("ln").collect()] == [("Xform", "root"), ("Mesh", "산소")]
    meta = {r.path: r for r in layers.stage_meta(table).collect()}["a.usda"]
    assert (meta.t0, meta.t1, meta.tps, meta.fps, meta.up_axis) == (1.0, 6.0, 24.0, 0.0, "Y")
    got = [(r.prim, r.frame, list(r.value)) for r in layers.samples(numbered, "xformOp:scale").orderBy("frame").collect()]
    assert got == [("산소", 1.0, [0.0] * 3), ("산소", 3.0, [1.0] * 3), ("산소", 5.0, [1.0] * 3), ("산소", 6.0, [0.0] * 3)]
    assert [r.asset for r in layers.asset_references(table).collect()] == ["tex/a.png"]
    after = lambda mode: {r.prim for r in layers.owned(numbered, mode).filter("line like '%asset%'").collect()}
    assert after("preceding") == {"산소"} and after("enclosing") == {"root"}


def test_freezing(table):
    out = {r.path: r.text for r in rewrite.frozen(table).collect()}
    assert FROZEN in out["a.usda"] and "translate.timeSamples" not in out["a.usda"]
    assert out["a.usda"].startswith(TEXT[: TEXT.index("        float3")]) and out["a.usda"].endswith("    asset inputs:file = @tex/a.png@\n}\n")
    assert out["b.usda"] == "" and out["c.usda"] is None


def test_patches_are_those_of_a_plain_splice(spark):
    rng, texts, patches = random.Random(1), [], []
    for k in range(20):
        text = "".join(rng.choice("abé\n") for _ in range(40))
        cuts = sorted(rng.sample(range(41), 2 * (k % 4)))
        mine = [(k, a, b, rng.choice(("", "<new>"))) for a, b in zip(cuts[::2], cuts[1::2])]
        want = text
        for _, a, b, r in reversed(mine):
            want = want[:a] + r + want[b:]
        texts.append((k, text, want))
        patches += mine
    made = spark.createDataFrame(texts, "path int, text string, want string")
    p = spark.createDataFrame(patches, "path int, start int, stop int, repl string")
    got = {r.path: r.text for r in rewrite.apply_patches(made, p).collect()}
    assert got == {k: want for k, _, want in texts}
    with pytest.raises(PySparkException, match="overlapping"):
        rewrite.apply_patches(made, spark.createDataFrame([(1, 0, 5, "x"), (1, 4, 6, "y")], p.schema)).collect()


def test_containers(spark):
    files = spark.createDataFrame([("p", 1, f"t{'x' * i}.png", b"data" * i) for i in range(70)] + [("p", 0, "root.usda", b"#usda"), ("q", 0, "e", b"")], "package string, place int, name string, data binary")
    made = {r.package: bytes(r.content) for r in containers.packages(files).collect()}
    for data in made.values():
        assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    assert zipfile.ZipFile(io.BytesIO(made["p"])).namelist()[0] == "root.usda"
    entries = containers.container_entries(containers.packages(files).withColumnRenamed("package", "path"))
    assert entries.filter("data_off % 64 <> 0 or method <> 0 or not crc_ok").count() == 0 and entries.count() == 72
    assert {r.path: r.ok for r in rules.verdict(rules.packaging(entries)).collect()} == {"p": True, "q": True}


def test_checks_and_stream(spark, table, tmp_path):
    problems = {r.path: list(r.problems) for r in rules.verdict(rules.layer_checks(table)).collect()}
    assert problems["a.usda"] == ["no moving translate", "no zero scale"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.usda").write_text(TEXT)
    query = watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(60) and query.exception() is None
    assert [list(r.problems) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [problems["a.usda"]]


def test_general_format(spark):
    values = [1.0, 0.1, 1234567.0, 1e-7, 2.5, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.s for r in df.select(general(df.x).alias("s")).collect()]
    assert got == [None if v is None else f"{v:g}" for v in values]


def test_leaked_cameras_and_lights(spark):
    texts = [("a", 'def Xform "Root"\n{\n    def Camera "Cam"\n    {\n    }\n    def DomeLight "Env"\n    {\n    }\n}\n'), ("b", 'def Xform "Camera"\n{\n}\n')]
    got = rules.layer_checks(spark.createDataFrame(texts, "path string, text string")).filter("check = 'no cameras or lights'").collect()
    assert {r.path: (r.ok, r.detail) for r in got} == {"a": (False, "2"), "b": (True, "0")}


NEXT_LINE = TEXT.replace("timeSamples = {", "timeSamples =\n        {")


def test_a_block_may_open_on_the_next_line(spark):
    both = spark.createDataFrame([("same", TEXT), ("next", NEXT_LINE)], "path string, text string")
    for attribute in ("xformOp:scale", "xformOp:translate"):
        for read in (layers.samples, layers.raw_samples):
            rows = read(layers.lines(both), attribute).drop("start", "ln")
            held = {p: sorted(str(r[1:]) for r in rows.collect() if r.path == p) for p in ("same", "next")}
            assert held["same"] == held["next"] != []
    out = {r.path: r.text for r in rewrite.frozen(both).collect()}
    assert out["same"] == out["next"] and FROZEN in out["next"]


def test_a_block_that_never_ends_is_read_but_not_rewritten(spark):
    text = TEXT[: TEXT.index("            6: (0, 0, 0)")]
    made = spark.createDataFrame([("a", text)], "path string, text string")
    assert layers.samples(layers.lines(made), "xformOp:scale").count() == 3
    assert rewrite.frozen(made).first().text == text


def test_large_packages_are_warned_of_above_25_megabytes(spark):
    limit = 25 * 1048576
    rows = [("a", "x", 0, 64, limit, 0, True), ("b", "x", 0, 64, limit + 1, 0, True)]
    got = rules.packaging(spark.createDataFrame(rows, containers.ENTRIES)).filter("check = 'size'").collect()
    assert {r.path: (r.ok, r.detail) for r in got} == {"a": (True, ""), "b": (True, "large")}


def test_layers_and_reports_are_written_as_files(spark, tmp_path, table):
    sinks.write_layers(table, str(tmp_path / "layers"))
    assert {r.path: r.text for r in sinks.read_written(spark, str(tmp_path / "layers")).collect()} == {"a.usda": TEXT, "b.usda": "\n"}
    back = layers.read_layers(spark, str(tmp_path / "layers" / "*" / "*.txt"))
    assert {r.text for r in back.collect()} == {r.text for r in layers.read_layers(spark, str(tmp_path / "layers" / "*" / "*.txt"), strict=True).collect()} == {TEXT, "\n"}
    checks = spark.createDataFrame([("a", "one", True, ""), ("a", "two", False, "3"), ("b", "one", True, None)], "path string, check string, ok boolean, detail string")
    assert {r.path: r.value for r in sinks.report(checks).collect()} == {"a": "FAIL two: 3\nok   one\nfailed", "b": "ok   one\npassed"}
    sinks.write_report(checks, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report" / "path=a")).count() == 3


def test_bad_bytes_are_replaced_or_an_error(spark, tmp_path):
    (tmp_path / "x.usda").write_bytes(b"ab\xffcd")
    assert layers.read_layers(spark, str(tmp_path / "x.usda")).first().text == "ab\ufffdcd"
    with pytest.raises(PySparkException):
        layers.read_layers(spark, str(tmp_path / "x.usda"), strict=True).collect()
    (tmp_path / "y.usdz").write_bytes(containers.packed([("a", b"1"), ("b", b"22")]))
    assert [(r.name, r.size) for r in containers.read_containers(spark, str(tmp_path / "y.usdz")).collect()] == [("a", 1), ("b", 2)]


def test_unknown_modes_and_missing_columns_are_errors(spark, table):
    with pytest.raises(ValueError, match="no such mode"):
        modes.run("undo", table)
    with pytest.raises(ValueError, match="text"):
        modes.run("fix", table.drop("text"))
    with pytest.raises(ValueError, match="mode"):
        geometry.recentre_delta(*[table.text] * 4, mode="other")


def test_frozen_layers_pass_and_others_fail_the_freeze_checks(table):
    done = rewrite.frozen(table)
    good = {r.path: r.ok for r in rules.verdict(rules.freeze_checks(table, done)).collect()}
    bad = {r.path: list(r.problems) for r in rules.verdict(rules.freeze_checks(table, table)).collect()}
    assert good["a.usda"] and good["b.usda"]
    assert bad["a.usda"] == ["no scale samples", "no translate samples", "visibility of each"]


def test_origins_move_to_the_centroid(spark):
    vertices = spark.createDataFrame([("a", 0, 1.0, 0.0, 0.0), ("a", 1, 3.0, 2.0, 4.0), ("b", 0, 5.0, 5.0, 5.0)], "object string, idx long, x double, y double, z double")
    objects = spark.createDataFrame([("a", None, [10.0, 0.0, 0.0]), ("b", "a", [0.0, 0.0, 0.0]), ("c", None, [1.0, 1.0, 1.0])], "name string, parent string, loc array<double>")
    moved, placed = geometry.origin_to_centroid(vertices, objects)
    assert sorted(tuple(r) for r in moved.collect()) == [("a", 0, -1.0, -1.0, -2.0), ("a", 1, 1.0, 1.0, 2.0), ("b", 0, 0.0, 0.0, 0.0)]
    assert {r.name: list(r.loc) for r in placed.collect()} == {"a": [12.0, 1.0, 2.0], "b": [5.0, 5.0, 5.0], "c": [1.0, 1.0, 1.0]}
    from pyspark.sql import functions as F

    around = geometry.recentred(objects, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    assert {r.name: list(r.loc) for r in around.collect()} == {"a": [9.0, -2.0, -3.0], "b": [0.0, 0.0, 0.0], "c": [0.0, -1.0, -2.0]}
    fixed = spark.createDataFrame([(0.0, 1.0, ["scale", "hide_render"]), (0.02, 1.0, ["scale"]), (0.0, 1.0, ["location"])], "d double, r double, p array<string>")
    assert [r.ok for r in fixed.select(rules.origin_fixed(fixed.d, fixed.r, fixed.p).alias("ok")).collect()] == [True, False, False]


def test_the_last_sample_of_a_frame_counts(spark):
    text = TEXT.replace("            6: (0, 0, 0),\n        }\n        double3", "            6: (0, 0, 0),\n            3: (4, 4, 4), 5: (9, 9, 9), 5: (2, 2, 2),\n        }\n        double3").replace("            4: (2.5, 0, 1),\n", "            4: (2.5, 0, 1),\n            1: (7, 7, 7),\n")
    out = rewrite.frozen(spark.createDataFrame([("a", text)], "path string, text string")).first().text
    # the greatest scale is 4 at frame 3; above 2 is seen from 3 on, and 2 at frame 5 is not
    assert "xformOp:scale = (4, 4, 4)" in out and "xformOp:translate = (7, 7, 7)" in out
    assert [x.strip() for x in out.split("\n") if '": ' not in x and ': "' in x] == ['1: "invisible",', '3: "inherited",', '5: "invisible",']


def test_injection_keeps_the_moves_and_coverage_counts_what_is_seen(table):
    out = {r.path: r.text for r in modes.run("inject", table).collect()}
    assert "xformOp:scale = (1, 1, 1)" in out["a.usda"] and "xformOp:translate.timeSamples = {" in out["a.usda"]
    lines = [x.strip() for x in out["a.usda"].split("\n")]
    at = lines.index("token visibility.timeSamples = {")
    assert lines[at + 1 : at + 5] == ['1: "invisible",', '3: "inherited",', '6: "invisible",', "}"]
    # the scale is above a half from 2.5 to 5.5 between its samples, so at frames 3 to 5
    assert sorted((r.path, r.frame, r.n) for r in modes.run("coverage", table).collect()) == [("a.usda", f, 0) for f in (1, 2, 6)]
    with pytest.raises(ValueError, match="component"):
        rewrite.visibility(table, component="z")
