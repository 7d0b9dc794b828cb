"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z to small letters; all other characters stay."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _CAPITALS, _SMALL))


def constants(values: list[int]) -> Column:
    """An array of whole numbers as one constant of the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once for each row however often it is used."""
    return F.transform(F.array(value), body).getItem(0)
