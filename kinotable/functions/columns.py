"""Column functions: text predicates, guarded arithmetic and small vectors."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: A number as scene layers write it (a fixed value).
NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def contains_any(text: Column, patterns: Iterable[str], case: str = "exact") -> Column:
    """Whether the text has one of the patterns.

    case: "exact"; "fold" upper-cases both sides; "text" upper-cases only the text.
    """
    found = F.lit(False)
    for p in patterns:
        found = found | (F.contains(text, F.lit(p)) if case == "exact" else F.contains(F.upper(text), F.lit(p.upper() if case == "fold" else p)))
    return found


def first_match(text: Column, pattern: str, default: Column | None = None) -> Column:
    """First group of the first match, else the default; an empty match counts as none."""
    found = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return found if default is None else F.coalesce(found, default)


def first_nonzero(*values: Column) -> Column:
    """The first value that is neither null nor zero, else 0."""
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values], F.lit(0.0))


def ratio(x: Column, y: Column, floor: float = 1e-9) -> Column:
    """x / y, or 0 where y is not above the floor."""
    return F.when(y > floor, x / y).otherwise(F.lit(0.0))


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def magnitude(v: Column) -> Column:
    """Greatest absolute component."""
    return F.array_max(F.transform(v, lambda x: F.abs(x)))


def add(v: Column, w: Column) -> Column:
    return F.zip_with(v, w, lambda a, b: a + b)


def subtract(v: Column, w: Column) -> Column:
    return F.zip_with(v, w, lambda a, b: a - b)


def scaled(v: Column, k: Column | float) -> Column:
    return F.transform(v, lambda a: a * k)


def midpoint(v: Column, w: Column) -> Column:
    return F.zip_with(v, w, lambda a, b: (a + b) / 2)


def affine(matrix: Column, point: Column) -> Column:
    """A 4 x 4 row-major matrix applied to a point of three numbers."""
    return F.transform(F.slice(matrix, 1, 3), lambda row: row[3] + F.aggregate(F.zip_with(F.slice(row, 1, 3), point, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))


def is_identity(matrix: Column, eps: float = 1e-6) -> Column:
    return F.forall(F.flatten(F.transform(matrix, lambda row, i: F.transform(row, lambda x, j: F.abs(x - F.when(i == j, 1.0).otherwise(0.0))))), lambda d: d <= eps)


def seconds(start: Column, end: Column, rate: Column) -> Column:
    """Length in seconds; null without a rate."""
    return F.try_divide(end - start, F.nullif(rate, F.lit(0.0)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_name(path: Column) -> Column:
    """All before the last slash; empty if there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def joined_path(folder: Column, path: Column) -> Column:
    """path under folder, without empty and ``.`` parts; ``..`` takes the part before it away, if there is one."""
    scheme = r"^([A-Za-z][\w+.-]*:(?://[^/]*)?)?(/?)"
    rest = F.regexp_replace(folder, scheme, "")
    parts = F.split(F.concat_ws("/", rest, path), "/")
    step = lambda held, part: F.when(part.isin("", "."), held).when((part == "..") & (F.size(held) > 0), F.slice(held, F.lit(1), F.size(held) - 1)).when(part == "..", held).otherwise(F.array_append(held, part))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.regexp_extract(folder, scheme, 1), F.regexp_extract(folder, scheme, 2), F.array_join(kept, "/"))


def unescaped(uri: Column) -> Column:
    """uri without percent escapes, and with three slashes where a local one has one."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/(?!/)", "file:///")


def escaped(uri: Column) -> Column:
    """uri with percent escapes for all but letters, digits, and what parts it."""
    out = F.url_encode(uri)
    for code, plain in (("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("%40", "@")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./\\]+)$", 1))


def aligned(size: Column, unit: int = 64) -> Column:
    """size, rounded up to a multiple of the unit."""
    return size + F.pmod(-size, F.lit(unit))


@F.arrow_udf(ArrayType(StringType()))
def _generals(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else [None if n is None or n != n else f"{n:g}" for n in v] for v in x.to_pylist()], pa.list_(pa.string()))


def generals(x: Column) -> Column:
    """Numbers of an array with six significant digits and no trailing zeros; the one Python function on columns."""
    return _generals(x.cast("array<double>"))


def general(x: Column) -> Column:
    """One number as ``generals`` tells it."""
    return generals(F.array(x))[0]
