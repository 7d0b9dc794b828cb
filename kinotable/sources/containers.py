"""Aligned stored containers: zip files whose payloads start at multiples of 64 bytes.

One file is one task's work, streamed entry by entry; a container is a package
of a few files, whose size the format bounds at 4 GB.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the zip format.
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
UTF8 = 0x800  # the flag of a name that is not ASCII
UNIT = 64
ENTRIES = "path string, name string, method int, data_off long, size long, crc long, crc_ok boolean"


def walk(data: bytes) -> Iterator[tuple[str, int, int, int, int, bool]]:
    """(name, method, payload offset, size, crc, crc holds) by the local headers; ends at the first other header."""
    at = 0
    while data[at : at + 4] == LOCAL and at + 30 <= len(data):
        _, _, method, _, _, crc, size, _, n, extra = struct.unpack_from("<HHHHHIIIHH", data, at + 4)
        start = at + 30 + n + extra
        payload = data[start : start + size]
        yield data[at + 30 : at + 30 + n].decode("utf-8", "replace"), method, start, size, crc, method != 0 or (len(payload) == size and zlib.crc32(payload) == crc)
        at = start + size


def packed(files: list[tuple[str, bytes]], unit: int = UNIT) -> bytes:
    """A stored zip of the files in order, each payload aligned by filling its extra field."""
    body, central = bytearray(), bytearray()
    for name, data in files:
        raw, at = name.encode(), len(body)
        fill = -(at + 30 + len(raw)) % unit
        if 0 < fill < 4:  # an extra field is 4 bytes at least
            fill += unit
        extra = struct.pack("<HH", 0x1986, fill - 4) + bytes(fill - 4) if fill else b""
        facts = struct.pack("<HHHHII", 0 if name.isascii() else UTF8, 0, 0, 0x21, zlib.crc32(data), len(data)) + struct.pack("<I", len(data))
        body += LOCAL + struct.pack("<H", 20) + facts + struct.pack("<HH", len(raw), len(extra)) + raw + extra + data
        central += CENTRAL + struct.pack("<HH", 20, 20) + facts + struct.pack("<HHHHHII", len(raw), 0, 0, 0, 0, 0, at) + raw
    n = len(files)
    return bytes(body) + bytes(central) + END + struct.pack("<HHHHIIH", 0, 0, n, n, len(central), len(body), 0)


def container_entries(files: DataFrame) -> DataFrame:
    """One row (ENTRIES) for each entry of each container in files (path, content)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ENTRIES.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            for path, data in zip(*(batch.column(i) for i in (0, 1))):
                rows = [(path.as_py(), *r) for r in walk(data.as_py() or b"")]
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.select("path", "content").mapInArrow(each, ENTRIES)


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    return container_entries(spark.read.format("binaryFile").load(path))


def packages(files: DataFrame, unit: int = UNIT) -> DataFrame:
    """(package, content): a container for each package of files (package, place, name, data); place 0 is the root layer."""
    held = files.groupBy("package").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name", "data"))), lambda s: F.struct(s["name"].alias("name"), s["data"].alias("data"))).alias("files"))

    @F.pandas_udf("binary")
    def pack(column):
        return column.map(lambda fs: packed([(f["name"], bytes(f["data"])) for f in fs], unit))

    return held.select("package", pack("files").alias("content"))
