"""Fill-in-middle: a text is cut into prefix, middle and suffix, and put together in another order.

A unit is a run of the letters A-Z and a-z, or any other single character.
While the units of a text are counted, a sparse index keeps the byte and
code-point offset of every ``STEP``-th unit; a cut is found by a binary search
in the index and a rescan of fewer than ``STEP`` units after the checkpoint.
A text is counted in pieces of ``PIECE`` bytes, so that memory besides the
text itself is bounded.

Where a text is cut and which form it takes follow from hashes of a seed and
the doc_id alone, so they are the same however rows are dealt to tasks, and
rows that agree in doc_id and text get the same result.  There is no shuffle.

Defined cases: a null text counts as empty, and an empty text stays plain.  A
text that holds one of the marks stays plain, so every output can be undone.
A null doc_id hashes as the empty string.  Bytes that are no UTF-8 are
replaced by U+FFFD first.  Only doc_id and text are read; other columns,
whatever their names, are left out of the result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before each part (fixed values of the format).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between two checkpoints, and bytes that are looked at at once.
STEP, PIECE = 256, 1 << 20
SEED = 1
#: Of a hundred texts, those that are transformed; of a hundred of these, those with the suffix first.
SHARE, SUFFIX_FIRST = 90, 20

_UNITS = re.compile(rb"[A-Za-z]+|[^A-Za-z\x80-\xff]|[\xc0-\xff][\x80-\xbf]*")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LATER = np.zeros(256, bool)
_LATER[128:192] = True


class UnitIndex:
    """Units of a UTF-8 text with checkpoints: byte and code-point offset of units 0, STEP, 2 * STEP and so on."""

    def __init__(self, text: bytes, step: int = STEP, piece: int = PIECE):
        self.text, self.step = text, step
        buf, n, points, letter = np.frombuffer(text, np.uint8), 0, 0, False
        units, at, points_at = [], [], []
        for low in range(0, len(buf), piece):
            part = buf[low : low + piece]
            letters, later = _LETTER[part], _LATER[part]
            begins = ~later
            begins[1:] &= ~(letters[1:] & letters[:-1])
            begins[0] &= not (letters[0] and letter)
            starts = np.flatnonzero(begins)
            marks = np.arange(-n % step, len(starts), step)
            if len(marks):
                units.append(n + marks)
                at.append(low + starts[marks])
                points_at.append(points + np.cumsum(~later)[starts[marks]] - 1)
            n, points, letter = n + len(starts), points + len(part) - int(np.count_nonzero(later)), bool(letters[-1])
        none = [np.zeros(0, np.int64)]
        self.units, self.bytes, self.points = (np.concatenate(x or none) for x in (units, at, points_at))
        self.n, self.n_points = n, points

    def cut(self, unit: int) -> tuple[int, int]:
        """(byte, code point) offset at which ``unit`` starts; unit n is the end of the text."""
        if unit >= self.n:
            return len(self.text), self.n_points
        near = int(np.searchsorted(self.units, unit, "right")) - 1
        begin = at = int(self.bytes[near])
        for _ in range(unit - int(self.units[near])):
            at = _UNITS.match(self.text, at).end()
        return at, int(self.points[near]) + len(self.text[begin:at].decode())


def hashes(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four whole numbers: the first groups of eight hex digits of the SHA-256 of ``seed:doc_id``."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _parted(text: pa.Array, first: pa.Array, second: pa.Array, form: pa.Array) -> pa.Array:
    n, prefix, middle, out = [], [], [], []
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for raw, h1, h2, kind in zip(text, first.to_pylist(), second.to_pylist(), form.to_pylist()):
        index = UnitIndex(t := raw.as_py().decode("utf-8", "replace").encode())
        n.append(index.n)
        if kind == "plain":
            prefix.append(None)
            middle.append(None)
            out.append(t)
            continue
        (a, pa_), (b, pb) = (index.cut(x) for x in sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
        prefix.append(pa_)
        middle.append(pb - pa_)
        out.append(b"".join((p, t[:a], s, t[b:], m, t[a:b]) if kind == "psm" else (s, t[b:], p, t[:a], m, t[a:b])))
    columns = [pa.array(n, pa.int64()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
    return pa.StructArray.from_arrays(columns, ["n", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: int = SEED, share: int = SHARE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output of every row of docs."""
    h = hashes(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (h[2] % 100 >= share), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    parted = F.arrow_udf(_parted, "n long, prefix_chars long, middle_chars long, output string")
    made = docs.select("doc_id", form.alias("form"), parted(text.cast("binary"), h[0], h[1], form).alias("made"))
    return made.select("doc_id", "made.n", "form", "made.prefix_chars", "made.middle_chars", "made.output")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
