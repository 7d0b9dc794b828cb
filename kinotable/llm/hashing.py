"""Vectorised hashing of words, shingles and byte windows over Arrow batches.

Every function here works on a flat ``uint8`` buffer that holds many texts one
after the other, so a batch costs a fixed number of numpy passes however many
texts it holds.  Hashes are sums of per-byte values times powers of an odd
base modulo 2**64, which lets the hash of any substring be read from one
running sum; a finaliser spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; bounds a task's memory.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        held = np.full(size, base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if size <= 4 * CHUNK_BYTES:
            _POWERS[base] = held
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def running_sum(buf: np.ndarray) -> np.ndarray:
    """``out[i]``: the weighted sum of the first i bytes, modulo 2**64."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[buf] * _powers(_BASE, len(buf)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span; equal spans hash alike wherever they stand."""
    inverse = _powers(_INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes sum to about ``limit``; one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary Arrow column; nulls count as empty texts."""
    wide = pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII capitals to small letters."""
    return _LOWER[buf]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each blank-separated word, and each text's first word.

    ``first`` has one entry more than there are texts.
    """
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = ~_BLANK[buf]
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    edges = offsets[1:-1]  # a word never runs on into the next text
    edges = edges[(edges > 0) & (edges < len(buf))]
    cut = edges[inside[edges] & inside[edges + 1]]
    begins[cut] = ends[cut] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, offsets)


def shingle_hashes(word: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words and each text's first shingle.

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_first = np.concatenate(([0], np.cumsum(count)))
    owner = np.repeat(np.arange(len(n)), count)
    at = first[owner] + np.arange(out_first[-1]) - out_first[owner]
    h = np.zeros(len(at), np.uint64)
    stop = first[owner + 1]
    for k in range(width):
        here = at + k
        ok = here < stop
        h = np.where(ok, (h * _U(_BASE) + word[np.minimum(here, max(len(word) - 1, 0))]) if len(word) else h, h)
    return mix(h + np.minimum(n, width)[owner].astype(np.uint64)), out_first
