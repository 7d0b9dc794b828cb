"""Data sources, containers as files, and assets beside layers."""

import io
import os
import zipfile
import zlib

import pytest
from pyspark.errors import PySparkException

from kinotable.sources import assets, container_files, containers, layers, stage_source

LAYER = """#usda 1.0
def Mesh "산소"
{
    float3 xformOp:scale.timeSamples = {
        1: (0, 0, 0), 3: (1, 2, 3),
    }
    double3 xformOp:translate.timeSamples =
    {
        1: (0, 0, 0),
        4: (2.5, 0, 1e-3) }
    token visibility.timeSamples = { 1: "invisible" }
    float3 xformOp:scale.timeSamples = { 7: (7, 7, 7) }
    def Mesh "inner"
    {
    }
    double3 xformOp:translate.timeSamples = {
        9: (9, 9, 9),
}
"""


@pytest.fixture
def folder(tmp_path):
    for i in range(5):
        (tmp_path / f"l{i}.usda").write_text(LAYER.replace("7", str(i)) if i else "")
    (tmp_path / "bad.usda").write_bytes(b'def Mesh "x\xff"\n{\nfloat3 xformOp:scale.timeSamples = { 1: (1, 1, 1) }\n}')
    (tmp_path / ".hidden").write_text(LAYER)
    return str(tmp_path)


def rows(df):
    return sorted((r.path.rpartition("/")[2], r.prim, r.attr, r.start, r.ln, r.frame, tuple(r.value)) for r in df.collect())


@pytest.mark.parametrize("size", [1, 500, 1 << 30])
def test_the_data_source_has_the_samples_of_the_parser(spark, folder, size):
    stage_source.register(spark)
    read = lambda: spark.read.format("scene_samples").option("groupbytes", size).load(folder)
    numbered = layers.lines(layers.read_layers(spark, f"{folder}/*.usda"))
    want = rows(layers.samples(numbered, "xformOp:scale").unionByName(layers.samples(numbered, "xformOp:translate")))
    assert rows(read()) == want and len(want) == 4 * 6 + 1
    assert len({r[0] for r in want}) == 5
    one = read().filter("attr = 'xformOp:scale'")
    both = read().filter("attr in ('xformOp:translate', 'other') and frame > 1")
    assert rows(one) == [r for r in want if r[2] == "xformOp:scale"]
    assert rows(both) == [r for r in want if r[2] == "xformOp:translate" and r[5] > 1]
    assert rows(read().filter("attr = 'a' and attr = 'xformOp:scale'")) == []
    if size == 1:
        assert read().rdd.getNumPartitions() == 6
    # the filter is the reader's work: Spark doesn't look at attr again
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "attr" not in "".join(x for x in plan.split("\n") if "Filter " in x and "BatchScan" not in x)


def test_pushed_filters_leave_others_to_spark():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    reader = stage_source.SampleReader({"path": "x"})
    rest = GreaterThan(("frame",), 1.0)
    assert list(reader.pushFilters([IsNotNull(("attr",)), In(("attr",), ("a", "b")), EqualTo(("attr",), "b"), rest, EqualTo(("prim",), "p")]))[0] is rest
    assert reader.wanted == {"b"}


FILES = "package string, place int, name string, data binary, source string"


def test_containers_are_written_as_files(spark, tmp_path):
    (tmp_path / "tex").mkdir()
    big = os.urandom(3_000_000)
    (tmp_path / "tex" / "ä big.png").write_bytes(big)
    source = f"file://{tmp_path}/tex/%C3%A4%20big.png"
    made = [("p.usdz", i, f"t{'x' * i}.png", b"data" * i, None) for i in range(1, 70)] + [("p.usdz", 0, "root.usda", b"#usda", None), ("p.usdz", 99, "tex/big.png", None, source), ("q.usdz", 0, "é", b"", None)]
    out = str(tmp_path / "out")
    for _ in range(2):  # once more: files are replaced
        container_files.write_containers(spark.createDataFrame(made, FILES), out)
        assert sorted(os.listdir(out)) == ["p.usdz", "q.usdz"]
    held = zipfile.ZipFile(f"{out}/p.usdz")
    assert held.testzip() is None and held.namelist()[0] == "root.usda" and held.read("tex/big.png") == big and len(held.namelist()) == 71
    assert zipfile.ZipFile(f"{out}/q.usdz").namelist() == ["é"]
    walked = sorted(map(tuple, containers.read_containers(spark, f"{out}/*.usdz").collect()))
    assert all(r[3] % 64 == 0 and r[6] for r in walked) and len(walked) == 72
    for piece in (1000, 1 << 20, 8 << 20):
        assert sorted(map(tuple, container_files.container_ranges(spark, f"{out}/*.usdz", piece).collect())) == walked


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    lost = [(f"p{i}", 0, "a", b"1", None) for i in range(8)] + [("p3", 1, "b", None, f"file://{tmp_path}/absent.png")]
    with pytest.raises(PySparkException):
        container_files.write_containers(spark.createDataFrame(lost, FILES), str(out))
    assert not out.exists() or os.listdir(out) == []
    with pytest.raises(PySparkException, match="name be that of a file"):
        container_files.write_containers(spark.createDataFrame([("../p", 0, "a", b"1", None)], FILES), str(out))
    assert not (tmp_path / "p").exists()


def test_a_task_that_ran_before_leaves_no_file(tmp_path):
    import pyarrow as pa

    batch = pa.record_batch([pa.array(["p", "p"]), pa.array([0, 1], pa.int32()), pa.array(["a", "b"]), pa.array([b"1", b"22"])], ["package", "place", "name", "data"])
    writer = container_files.ContainerWriter({"path": str(tmp_path)}, False)

    def killed():
        yield batch
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(killed())
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == []
    done = writer.write(iter([batch]))
    writer.commit([done, None])
    assert os.listdir(tmp_path) == ["p"] and zipfile.ZipFile(tmp_path / "p").namelist() == ["a", "b"]
    with pytest.raises(ValueError, match="more than one task"):
        writer.commit([done, done])
    writer.abort([done])
    assert os.listdir(tmp_path) == ["p"]


def test_damaged_entries_are_found(spark, tmp_path):
    data = bytearray(containers.packed([("a", b"x" * 5000), ("b", b"y" * 5000), ("c", b"")]))
    at = data.index(b"y" * 10)
    data[at + 4321] ^= 1
    (tmp_path / "d.usdz").write_bytes(data)
    for piece in (100, 4096, 1 << 20):
        got = {r.name: r.crc_ok for r in container_files.container_ranges(spark, str(tmp_path / "d.usdz"), piece).collect()}
        assert got == {"a": True, "b": False, "c": True}
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("deflated", b"z" * 1000)
    (tmp_path / "e.usdz").write_bytes(packed.getvalue())
    assert [(r.method, r.crc_ok) for r in container_files.container_ranges(spark, str(tmp_path / "e.usdz")).collect()] == [(8, True)]
    (tmp_path / "f.usdz").write_bytes(b"no zip at all")
    with pytest.raises(PySparkException, match="no container"):
        container_files.container_ranges(spark, str(tmp_path / "f.usdz")).collect()


def test_checksums_of_parts_join():
    data = os.urandom(10_000)
    for cut in (0, 1, 77, 9_999, 10_000):
        assert container_files.shifted(zlib.crc32(data[:cut]), len(data) - cut) ^ zlib.crc32(data[cut:]) == zlib.crc32(data)


def test_assets_are_found_packed_or_told_as_missing(spark, tmp_path):
    for name, data in (("a/tex/one.png", b"1"), ("shared/two.png", b"22"), ("a/three.png", b"333"), ("abs/four.png", b"4444")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    refs = f"@tex/one.png@ @./three.png@ @../shared/two.png@ @{tmp_path}/abs/four.png@ @./gone.png@ @other.usda@ @tex/one.png@ @tex/../three.png@"
    (tmp_path / "a" / "scene.usda").write_text(refs)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "second.usda").write_text("@../shared/two.png@ @nowhere/x.png@")
    (tmp_path / "b" / "bare.usda").write_text("nothing here")
    made = layers.read_layers(spark, f"{tmp_path}/*/*.usda")
    missing = assets.export(made, assets.listing(spark, str(tmp_path)), str(tmp_path / "out"))
    assert {r.path.rpartition("/")[2]: list(r.missing) for r in assets.report_missing(missing).collect()} == {"scene.usda": ["./gone.png"], "second.usda": ["nowhere/x.png"]}
    held = zipfile.ZipFile(tmp_path / "out" / "scene.usdz")
    assert held.testzip() is None
    assert {n: held.read(n) for n in held.namelist()[1:]} == {"tex/one.png": b"1", "three.png": b"333", "../shared/two.png": b"22", "four.png": b"4444", "tex/../three.png": b"333"}
    assert held.namelist()[0] == "scene.usda" and held.read("scene.usda").decode() == refs
    assert zipfile.ZipFile(tmp_path / "out" / "second.usdz").namelist() == ["second.usda", "../shared/two.png"]
    assert zipfile.ZipFile(tmp_path / "out" / "bare.usdz").namelist() == ["bare.usda"]


def test_odd_names_of_files(spark, tmp_path):
    odd = tmp_path / "a b+é%20"
    odd.mkdir()
    (odd / "l x.usda").write_text("@k é%41.png@ @no such.png@")
    (odd / "k é%41.png").write_bytes(b"1")
    made = layers.read_layers(spark, f"{tmp_path}/*/*.usda")
    missing = assets.export(made, assets.listing(spark, str(tmp_path)), str(tmp_path / "out"))
    assert [r.asset for r in missing.collect()] == ["no such.png"]
    held = zipfile.ZipFile(tmp_path / "out" / "l x.usdz")
    assert held.namelist() == ["l x.usda", "k é%41.png"] and held.read("k é%41.png") == b"1"
    stage_source.register(spark)
    assert spark.read.format("scene_samples").load(str(odd)).count() == 0
