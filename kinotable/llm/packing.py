"""Token-ID / binary output: tokenise, split, and pack into fixed-length rows.

Each document becomes its token ids and one end id.  Documents longer than a
row are split losslessly into row-length pieces and a rest.  Pieces are packed
best-fit-decreasing: the longest piece first, each into the fullest row that
still has room, found by a segment tree over free capacities.  Packing works
on groups of about ``group_tokens`` tokens inside a task, so memory is bounded
and nothing is shuffled; a lost task packs the same rows again.

Defined cases: a null or empty text is one end id; repeated rows are packed
each on its own; an empty table gives no rows; nulls in doc_id stay null; ids
that do not fit into 16 bits raise an error.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary lies on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Word pattern of that vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The id that ends each document; free in that vocabulary.
END_ID = 50256
#: Ids in a row, and tokens packed together.
ROW_TOKENS, GROUP_TOKENS = 2048, 1 << 21

_LOADED: dict[str, Callable[[str], np.ndarray]] = {}


def tokenizer(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids; loaded once in each Python worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        _LOADED[path] = lambda text: np.array(own.encode_ordinary(text), np.int64)
    return _LOADED[path]


class Capacities:
    """Open rows by free capacity; ``best(n)`` finds the least capacity that holds n."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.some = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        at = self.size + free
        while at and not self.some[at]:
            self.some[at] = 1
            at >>= 1

    def best(self, n: int) -> int:
        """The least capacity of n or more that an open row has, else -1."""
        at = self.size + n
        if self.some[at]:
            return n
        while at > 1 and (at & 1 or not self.some[at ^ 1]):
            at >>= 1
        if at <= 1:
            return -1
        at ^= 1
        while at < self.size:
            at = 2 * at if self.some[2 * at] else 2 * at + 1
        return at - self.size

    def pop(self, free: int) -> int:
        row = self.rows[free].pop()
        if not self.rows[free]:
            at = self.size + free
            while at and not (at < self.size and (self.some[2 * at] or self.some[2 * at + 1])):
                self.some[at] = 0
                at >>= 1
        return row


def best_fit_decreasing(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Piece numbers in each row, in the order in which they were placed."""
    rows: list[list[int]] = []
    free = Capacities(room)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = free.best(n)
        if fit < 0:
            row, fit = len(rows), room
            rows.append([])
        else:
            row = free.pop(fit)
        rows[row].append(i)
        if fit > n:
            free.add(fit - n, row)
    return rows


SCHEMA = "doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, position_resets array<int>, n_tokens int, ids binary"


def _packed(group: list[tuple[int | None, np.ndarray]], room: int, end_id: int) -> pa.RecordBatch:
    pieces = [(doc_id, at, ids[at : at + room]) for doc_id, ids in group for at in range(0, len(ids), room)]
    columns: list[list] = [[] for _ in range(6)]
    for row in best_fit_decreasing(np.array([len(p[2]) for p in pieces]), room):
        held = [pieces[i] for i in row]
        ends = np.cumsum([0] + [len(p[2]) for p in held])
        ids = np.full(room, end_id, np.uint16)
        ids[: ends[-1]] = np.concatenate([p[2] for p in held])
        for column, x in zip(columns, ([p[0] for p in held], [p[1] for p in held], ends, ends[:-1], int(ends[-1]), ids.astype("<u2").tobytes())):
            column.append(x)
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])


def packed_rows(docs: DataFrame, vocabulary: str = VOCABULARY, row_tokens: int = ROW_TOKENS, group_tokens: int = GROUP_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Rows of a token-id matrix, each ``row_tokens`` wide.

    ``ids`` are little-endian unsigned 16-bit ids filled up with the end id;
    ``cu_seqlens`` the cumulative segment lengths, ``n_tokens`` the last of
    them; ``position_resets`` where positions start again at 0; ``doc_ids``
    and ``doc_starts`` the document of each segment and the token of it that
    the segment starts with.  Sorted by doc_start, a document's segments give
    its ids back exactly.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, group, held, most = tokenizer(vocabulary), [], 0, np.iinfo(np.uint16).max
        if end_id > most:
            raise ValueError(f"ids are written in 16 bits, up to {most}")
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = encode((text.as_py() or b"").decode("utf-8", "replace"))
                if len(ids) and ids.max() > most:
                    raise ValueError(f"ids are written in 16 bits, up to {most}; the vocabulary has {ids.max()}")
                group.append((doc_id.as_py(), np.append(ids, end_id).astype(np.uint16)))
                held += len(ids) + 1
                if held >= group_tokens:
                    yield _packed(group, row_tokens, end_id)
                    group, held = [], 0
        if group:
            yield _packed(group, row_tokens, end_id)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(pack, SCHEMA).select(F.monotonically_increasing_id().alias("row_id"), "*")


def positions(cu_seqlens: np.ndarray, row_tokens: int = ROW_TOKENS) -> np.ndarray:
    """Position of each id of a row: counts up from 0 in each segment and in the filling."""
    ends = np.append(cu_seqlens, row_tokens)
    return np.arange(row_tokens) - np.repeat(ends[:-1], np.diff(ends))


def write_packed(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; ids of a file, joined, are its matrix."""
    rows.write.mode("overwrite").parquet(path)
