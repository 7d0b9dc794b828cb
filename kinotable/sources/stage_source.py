"""Samples of layers as a Spark data source: ``spark.read.format("scene_samples").load(folder)``.

A partition is a group of files; a file is streamed line by line, so memory
does not grow with it.  Filters on ``attr`` by equality or by a list reach the
reader, which then looks at no other block.  A file is one task's work; a
layer that is too large for that is read by ``structure.file_lines``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from io import TextIOWrapper

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from kinotable.functions.columns import NUMBER
from kinotable.sources.files import listed, opened
from kinotable.sources.structure import STAGE

SCHEMA = "path string, prim string, attr string, start long, ln long, frame double, value array<double>"
#: Bytes of files that make a partition.
GROUP_BYTES = 64 << 20

_DEFINED = re.compile(r'\s*def\s+\w+\s+"([^"]+)"')
_OPENING = re.compile(r"([\w:]+)\.timeSamples\s*=")
_SAMPLE = re.compile(rf"({NUMBER})\s*:\s*\(\s*({NUMBER})\s*,\s*({NUMBER})\s*,\s*({NUMBER})\s*\)")


def samples_of(path: str, lines: Iterable[str], wanted: set[str] | None) -> Iterator[tuple]:
    """Rows of three-number samples in the order of the file."""
    prim, depth, block = STAGE, 0, None
    for ln, line in enumerate(lines):
        if named := _DEFINED.match(line):
            prim = named[1]
        before, depth = depth, depth + line.count("{") - line.count("}")
        body = line
        if mark := _OPENING.search(line):
            block = (mark[1], ln, before, prim) if wanted is None or mark[1] in wanted else None
            body, begun = line[mark.end() :], False
        if block:
            for found in _SAMPLE.finditer(body):
                frame, *value = map(float, found.groups())
                yield path, block[3], block[0], block[1], ln, frame, value
            begun = begun or "{" in body
            if begun and depth <= block[2]:
                block = None


class Group(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class SampleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("groupbytes", GROUP_BYTES))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if getattr(one, "attribute", None) == ("attr",) and isinstance(one, (EqualTo, In)):
                values = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            elif not (isinstance(one, IsNotNull) and one.attribute == ("attr",)):
                yield one

    def partitions(self) -> list[InputPartition]:
        out, held = [], 0
        for file, size in listed(self.path):
            if not out or held + size > self.size:
                out.append(Group([]))
                held = 0
            out[-1].files.append(file)
            held += size
        return out or [Group([])]

    def read(self, partition: Group) -> Iterator[tuple]:
        for uri in partition.files if partition else []:
            store, path = opened(uri)
            with store.open_input_file(path) as raw, TextIOWrapper(raw, "utf-8", "replace", "\n") as lines:
                yield from samples_of(uri, lines, self.wanted)


class SceneSamples(DataSource):
    """Rows of ``SCHEMA`` of all layers in a folder."""

    @classmethod
    def name(cls) -> str:
        return "scene_samples"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SampleReader:
        return SampleReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SceneSamples)
