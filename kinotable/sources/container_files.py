"""Containers as files: written entry by entry by a data source, read by seeks, checked in ranges.

Neither way makes a container, or a payload that comes from a file, one value.
The format itself bounds a container at 4 GB and 65,535 entries; more is an error.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from kinotable.sources.containers import CENTRAL, END, ENTRIES, LOCAL, UNIT, UTF8
from kinotable.sources.files import opened

#: Bytes that are read, copied or checked at once.
PIECE = 8 << 20
#: The polynomial of CRC-32, lowest power first (a fixed value).
POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32; the highest of 32 bits is the power 0."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def shifted(crc: int, n: int) -> int:
    """What a part's checksum adds to that of the whole if n bytes follow it; the checksum of a whole is the exclusive or over its parts."""
    power, square = 1 << 31, 1 << 23  # 1, and the step of one byte
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return _times(power, crc)


def _pieces(data: bytes | None, source: str | None) -> Iterator[bytes]:
    if source is None:
        yield data or b""
        return
    store, path = opened(source)
    with store.open_input_stream(path) as held:
        while piece := held.read(PIECE):
            yield piece


class Container:
    """One container that is being written to a stream."""

    def __init__(self, out, unit: int):
        self.out, self.unit, self.at, self.central, self.n = out, unit, 0, bytearray(), 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes | None, source: str | None) -> None:
        raw, begin, crc, size = name.encode(), self.at, 0, 0
        for piece in _pieces(data, source):
            crc, size = zlib.crc32(piece, crc), size + len(piece)
        gap = -(begin + 30 + len(raw)) % self.unit
        gap += self.unit if 0 < gap < 4 else 0  # an extra field has a head of 4 bytes
        if begin + 30 + len(raw) + gap + size + len(self.central) > 0xFFFFFFFF or self.n == 0xFFFF:
            raise ValueError("a container holds 4 GB and 65,535 entries at most")
        extra = struct.pack("<HH", 0x1986, gap - 4) + bytes(gap - 4) if gap else b""
        facts = struct.pack("<HHHHIII", 0 if name.isascii() else UTF8, 0, 0, 0x21, crc, size, size)
        self._put(LOCAL + struct.pack("<H", 20) + facts + struct.pack("<HH", len(raw), gap) + raw + extra)
        for piece in _pieces(data, source):
            self._put(piece)
        self.central += CENTRAL + struct.pack("<HH", 20, 20) + facts + struct.pack("<HHHHHII", len(raw), 0, 0, 0, 0, 0, begin) + raw
        self.n += 1

    def close(self) -> None:
        begin = self.at
        self._put(bytes(self.central) + END + struct.pack("<HHHHIIH", 0, 0, self.n, self.n, len(self.central), begin, 0))
        self.out.close()


@dataclass
class Written(WriterCommitMessage):
    """A task's finished containers: where they wait, and their names."""

    files: list[tuple[str, str]]


class ContainerWriter(DataSourceArrowWriter):
    """Tasks write into a hidden folder; commit moves the files of successful tasks out of it, abort deletes it."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.unit, self.overwrite = options["path"].rstrip("/"), int(options.get("unit", UNIT)), overwrite
        self.pending = f"{self.folder}/.pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        mine, files, held = f"{self.pending}/{uuid.uuid4().hex}", [], None
        store, top = opened(mine)
        store.create_dir(top, recursive=True)
        for batch in iterator:
            sources = batch.column("source") if "source" in batch.schema.names else pa.nulls(len(batch), pa.string())
            for package, name, data, source in zip(batch.column("package"), batch.column("name"), batch.column("data"), sources):
                package = package.as_py()
                if not files or files[-1][1] != package:
                    if not package or "/" in package or package in (".", "..") or any(package == p for _, p in files):
                        raise ValueError(f"rows of a package must follow each other, and its name be that of a file: {package!r}")
                    if held:
                        held.close()
                    files.append((f"{mine}/{package}", package))
                    held = Container(store.open_output_stream(f"{top}/{package}"), self.unit)
                held.add(name.as_py(), data.as_py(), source.as_py())
        if held:
            held.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        if len({name for _, name in files}) < len(files):
            raise ValueError("a package's rows came to more than one task")
        store, top = opened(self.folder)
        if self.overwrite:
            for old in store.get_file_info(pa.fs.FileSelector(top)):
                if old.type == pa.fs.FileType.File:
                    store.delete_file(old.path)
        for waiting, name in files:
            store.move(opened(waiting)[1], f"{top}/{name}")
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        store, path = opened(self.pending)
        if store.get_file_info(path).type == pa.fs.FileType.Directory:
            store.delete_dir(path)


class AlignedContainers(DataSource):
    """Writes rows (package, place, name, data, and if there is one source) as one aligned stored container for each package."""

    @classmethod
    def name(cls) -> str:
        return "aligned_containers"

    def schema(self) -> str:
        return "package string, place int, name string, data binary, source string"

    def writer(self, schema: StructType, overwrite: bool) -> ContainerWriter:
        return ContainerWriter(dict(self.options), overwrite)


def write_containers(files: DataFrame, folder: str, unit: int = UNIT) -> None:
    """A file ``folder``/package for each package of files (package, place, name, data, and if there is one source).

    Where source is not null, the payload is copied from that file piece by
    piece.  Entries stand in the order of place, which tells the root layer.
    Until all tasks have ended nothing is seen in the folder; a failed write
    leaves nothing behind.  Packages that are there already are replaced.
    """
    files.sparkSession.dataSource.register(AlignedContainers)
    source = F.col("source") if "source" in files.columns else F.lit(None).cast("string").alias("source")
    rows = files.select("package", F.col("place").cast("int").alias("place"), "name", F.col("data").cast("binary").alias("data"), source)
    rows.repartition("package").sortWithinPartitions("package", "place").write.format("aligned_containers").option("unit", unit).mode("append").save(folder)


def _directory(uri: str, length: int) -> Iterator[tuple]:
    """(name, method, payload offset, size, crc) from the central directory; reads the directory and the local headers."""
    store, path = opened(uri)
    with store.open_input_file(path) as held:
        held.seek(max(0, length - 22 - 0xFFFF))
        tail = held.read()
        at = tail.rfind(END)
        if at < 0:
            raise ValueError(f"no container: {uri}")
        n, size, begin = struct.unpack_from("<HII", tail, at + 10)
        held.seek(begin)
        raw, at = held.read(size), 0
        for _ in range(n):
            method, _, _, crc, packed, _, a, b, c = struct.unpack_from("<HHHIIIHHH", raw, at + 10)
            local = struct.unpack_from("<I", raw, at + 42)[0]
            held.seek(local + 26)
            yield raw[at + 46 : at + 46 + a].decode("utf-8", "replace"), method, local + 30 + sum(struct.unpack("<HH", held.read(4))), packed, crc
            at += 46 + a + b + c


def directories(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, method, data_off, size, crc) of the entries of container files; payloads are not read."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for uri, length in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(uri, *row) for row in _directory(uri, length)]
                yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "name", "method", "data_off", "size", "crc"])

    found = spark.read.format("binaryFile").load(path).select("path", "length")
    return found.mapInArrow(each, "path string, name string, method int, data_off long, size long, crc long")


def container_ranges(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """The rows (ENTRIES) of ``read_containers``, of files of any size: payloads are checked in ranges of ``piece`` bytes, each row of its own task's work.

    A part's checksum is moved to its place in the whole, and those of an
    entry are joined by exclusive or, in any order.  Compressed entries are
    not checked, as in ``read_containers``.
    """
    entries = directories(spark, path)
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(piece).cast("long")))
    ranges = entries.filter("method = 0").select("path", "name", "data_off", "size", begin.alias("lo"))
    ranges = ranges.withColumn("n", F.least(F.col("size") - F.col("lo"), F.lit(piece).cast("long"))).withColumn("after", F.col("size") - F.col("lo") - F.col("n"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for uri, off, lo, n, after in zip(*(batch.column(c).to_pylist() for c in ("path", "data_off", "lo", "n", "after"))):
                store, place = opened(uri)
                with store.open_input_file(place) as held:
                    held.seek(off + lo)
                    data = held.read(n)
                parts.append(shifted(zlib.crc32(data), after) if len(data) == n else None)
            # a range that the file lacks makes the entry's checksum wrong whatever the others are
            yield pa.record_batch([batch.column("path"), batch.column("name"), batch.column("data_off"), pa.array([p or 0 for p in parts], pa.int64()), pa.array([p is not None for p in parts])], ["path", "name", "data_off", "part", "whole"])

    keys = ["path", "name", "data_off"]
    checked = ranges.repartition("path", "data_off", "lo").mapInArrow(each, "path string, name string, data_off long, part long, whole boolean")
    summed = checked.groupBy(*keys).agg(F.bit_xor("part").alias("got"), F.every("whole").alias("whole"))
    ok = F.when(F.col("method") != 0, True).otherwise(F.coalesce((F.col("got") == F.col("crc")) & F.col("whole"), F.lit(False)))
    return entries.join(summed, keys, "left").withColumn("crc_ok", ok).select(*[x.split()[0] for x in ENTRIES.split(", ")])
