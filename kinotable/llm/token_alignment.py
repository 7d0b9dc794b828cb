"""Cross-tokenizer alignment: which tokens of one vocabulary go with which of another.

Both tokenizers encode a text with a space before it.  Where tokens of both
end at the same byte, the text is cut; the tokens between two cuts are a
group, and all A-B pairs of a group are linked.  The count of an id pair is
the number of documents that hold it linked.

**Postings cogroup.**  Documents are encoded once, in blocks; a block yields
for each A id it holds one posting row: its B ids, and for each the documents
and how often they link the pair.  Counts are summed per pair before they
are shuffled.  Posting rows and count rows then meet by A id, sorted so that
an A id's counts come first: a task streams them, holds the counts of one A
id (no more than B has ids), and emits what each document gets from it,
already summed over the A ids of the task while memory allows.  These
contributions go, a row for a block of documents, to one task each block and
are summed by document.

An A id with very many postings is dealt to several keys, each of which gets a
copy of its counts.  How many follows from its postings; the list of such ids
is no longer than A's vocabulary, so it may be broadcast.

Defined cases: a text that is null or empty, or whose joined A or B token
bytes differ from space and text (as where it holds the B vocabulary's space
mark), has no tokens: zeros and an empty digest.  Bytes that are no UTF-8 are
such a case.  Rows that agree in doc_id or text are documents of their own.
Only doc_id and text are read; clashing names of other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinotable.llm.saving import checkpointed

#: Ranks of the byte-level vocabulary A (the ids of byte_bpe_50k.json), and the piece model B.
RANKS, PIECES = "/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/piece_bpe_32k.model"
#: How A's vocabulary cuts a text before its merges (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Links of a block of documents, and documents of it at most (its numbers have 16 bits).
BLOCK_LINKS, BLOCK_DOCS = 1 << 20, 1 << 14
#: Pairs of a group above which equal ids are counted before they are paired.
WIDE = 4096
#: Postings of an A id that go to one key; no fewer than so many times its B ids.
SHARD, COPIES = 20_000, 16
#: Postings that are worked on at once, and contributions that are held.
AT_ONCE, HELD = 1 << 20, 1 << 20

_LOADED: dict[tuple[str, str], Pair] = {}


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, ranks: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as lines:
            held = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=held, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes = [b""] * (max(held.values()) + 1)
        for token, rank in held.items():
            self.a_bytes[rank] = token
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        # ids as decimal digits with what follows them, one of four marks
        self.digits = np.zeros((max(len(self.a_bytes), len(self.b_bytes)), 4, 8), np.uint8)
        for k, mark in enumerate((b",", b"|", b";", b"")):
            for i in range(len(self.digits)):
                told = str(i).encode() + mark
                self.digits[i, k, : len(told)] = list(told)

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """A's and B's ids, or None where they don't give space and text back."""
        try:
            plain = text.decode()
        except UnicodeDecodeError:
            return None
        a, b = self.a.encode_ordinary(" " + plain), self.b.encode(plain, num_threads=1)
        want = b" " + text
        if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The end of each group among A's tokens and among B's."""
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        return at_a + 1, at_b + 1

    def told(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
        """The groups as ``a1,a2|b1;a3|b2``."""
        group_a, group_b = np.searchsorted(ends_a, np.arange(len(a)), "right"), np.searchsorted(ends_b, np.arange(len(b)), "right")
        places = [np.arange(len(a)) + np.append(0, ends_b)[group_a], np.arange(len(b)) + ends_a[group_b]]
        ids, marks = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        ids[places[0]], ids[places[1]] = a, b
        marks[places[0][ends_a - 1]], marks[places[1][ends_b - 1]] = 1, 2
        marks[-1] = 3
        digits = self.digits[ids, marks].ravel()
        return digits[digits != 0].tobytes()


def tokenizers(ranks: str, pieces: str) -> Pair:
    """Loaded once in each Python worker."""
    if (ranks, pieces) not in _LOADED:
        _LOADED[ranks, pieces] = Pair(ranks, pieces)
    return _LOADED[ranks, pieces]


def linked(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, times): distinct linked id pairs, A's id times 2**16 and B's, with the number of their links."""
    n_a, n_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    wide = n_a * n_b > WIDE
    sizes = np.where(wide, 0, n_a * n_b)
    group = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x = a[ends_a[group] - n_a[group] + at // np.maximum(n_b, 1)[group]]
    y = b[ends_b[group] - n_b[group] + at % np.maximum(n_b, 1)[group]]
    pair, times = np.unique(x << 16 | y, return_counts=True)
    for g in np.flatnonzero(wide):
        ids_a, by_a = np.unique(a[ends_a[g] - n_a[g] : ends_a[g]], return_counts=True)
        ids_b, by_b = np.unique(b[ends_b[g] - n_b[g] : ends_b[g]], return_counts=True)
        both = np.concatenate((pair, (ids_a[:, None] << 16 | ids_b).ravel()))
        pair, back = np.unique(both, return_inverse=True)
        times = np.bincount(back, np.concatenate((times, np.outer(by_a, by_b).ravel()))).astype(np.int64)
    return pair, times


_ROWS = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, bs array<int>, n_docs array<int>, docs array<int>, times array<long>"
_KINDS = [pa.int64()] * 6 + [pa.string(), pa.int32()] + [pa.list_(pa.int32())] * 3 + [pa.list_(pa.int64())]
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def _with(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([columns.get(name, pa.nulls(n, kind)) for name, kind in zip(_NAMES, _KINDS)], _NAMES)


def _postings(block: int, pairs: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each A id of a block: its B ids, for each the number of its documents, and these with their links."""
    sizes = np.array([len(x) for x in pairs])
    doc, pair, time = np.repeat(np.arange(len(pairs)), sizes), np.concatenate(pairs), np.concatenate(times)
    order = np.argsort(pair << 16 | doc)
    doc, pair, time = doc[order], pair[order], time[order]
    new = np.flatnonzero(np.diff(pair, prepend=-1))
    a = pair[new] >> 16
    first = np.flatnonzero(np.diff(a, prepend=-1))
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(np.append(at, len(values)), pa.int32()), values)
    return _with(
        len(first), key=pa.array(np.full(len(first), block)), a=pa.array(a[first], pa.int32()), bs=lists(first, pa.array(pair[new] & 0xFFFF, pa.int32())), n_docs=lists(first, pa.array(np.diff(new, append=len(pair)), pa.int32())),
        docs=lists(new[first], pa.array(doc, pa.int32())), times=lists(new[first], pa.array(time, pa.int64())),
    )


def _encoded(docs: DataFrame, ranks: str, pieces: str) -> DataFrame:
    """Rows of documents (key, doc_id, what they hold), and posting rows (key of a block, a, bs, ...).

    The key of a document is that of its block plus its place in it.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, block = tokenizers(ranks, pieces), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        pairs: list[np.ndarray] = []
        times: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), _KINDS)]
            yield _with(len(rows), **dict(zip(_NAMES, columns)))
            if size:
                yield _postings(block, pairs, times)

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = raw.as_py()
                ids = both.encode(text) if text else None
                pair, time, row = np.zeros(0, np.int64), np.zeros(0, np.int64), (0, 0, 0, 0, "")
                if ids is not None:
                    ends = both.groups(*ids)
                    pair, time = linked(*ids, *ends)
                    row = (len(ids[0]), len(ids[1]), len(ends[0]), int(time.sum()), hashlib.sha256(both.told(*ids, *ends)).hexdigest())
                rows.append((block + len(rows), doc_id, *row))
                pairs.append(pair)
                times.append(time)
                size += len(pair)
                if size >= BLOCK_LINKS or len(rows) == BLOCK_DOCS:
                    yield from out()
                    block, size = block + BLOCK_DOCS, 0
                    for x in (rows, pairs, times):
                        x.clear()
        if rows:
            yield from out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(of, _ROWS)


_GIVEN = "block long, docs array<int>, n_best array<long>, count_sum array<long>"


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What documents get from rows (a, key, bs, n_docs, docs, times); rows without a key are an A id's counts, n_docs, and come first."""
    flat = lambda column, kind: column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    known, count, best = (np.zeros(0, np.int64) for _ in range(3))
    held: list[np.ndarray] = []

    def summed(parts: list[np.ndarray]) -> np.ndarray:
        key, n_best, total = np.concatenate(parts, axis=1)
        ids, back = np.unique(key, return_inverse=True)
        out = np.zeros((3, len(ids)), np.int64)
        out[0] = ids
        np.add.at(out[1], back, n_best)
        np.add.at(out[2], back, total)
        return out

    def batch_of(part: np.ndarray) -> pa.RecordBatch:
        """A row for each block, whose documents stand together."""
        block = part[0] - part[0] % BLOCK_DOCS
        first = np.flatnonzero(np.diff(block, prepend=-1))
        ends = pa.array(np.append(first, len(block)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(part[0] - block, pa.int32()), pa.array(part[1]), pa.array(part[2]))]
        return pa.record_batch([pa.array(block[first]), *lists], ["block", "docs", "n_best", "count_sum"])

    for batch in batches:
        a = batch.column(0).to_numpy().astype(np.int64)
        counts = pa.compute.is_null(batch.column(1)).to_numpy(zero_copy_only=False)
        if counts.any():
            mine = batch.filter(pa.array(counts))
            sizes = pa.compute.list_value_length(mine.column(2)).to_numpy(zero_copy_only=False)
            own = np.repeat(a[counts], sizes) << 16 | flat(mine.column(2), np.int64)
            n = flat(mine.column(3), np.int64)
            top = np.repeat(np.maximum.reduceat(n, np.cumsum(sizes) - sizes), sizes)
            # of what was known, only the last A id can still come up
            last = known >> 16 == (known[-1] >> 16 if len(known) else 0)
            known, at = np.unique(np.concatenate((known[last], own)), return_index=True)
            count, best = np.concatenate((count[last], n))[at], np.concatenate((best[last], n == top))[at]
        rows = np.flatnonzero(~counts)
        if not len(rows):
            continue
        all_sizes = pa.compute.list_value_length(batch.column(4)).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.cumsum(all_sizes[rows])
        low = 0
        while low < len(rows):
            high = max(low + 1, int(np.searchsorted(cuts, (cuts[low - 1] if low else 0) + AT_ONCE, "right")))
            part = batch.take(pa.array(rows[low:high]))
            n_pairs, n_docs, docs = pa.compute.list_value_length(part.column(2)).to_numpy(), flat(part.column(3), np.int64), flat(part.column(4), np.int64)
            pair = np.repeat(a[rows[low:high]], n_pairs) << 16 | flat(part.column(2), np.int64)
            at = np.repeat(np.searchsorted(known, pair), n_docs)
            key, times = np.repeat(part.column(1).to_numpy(), all_sizes[rows[low:high]]) + docs, flat(part.column(5), np.int64)
            held.append(np.stack((key, times * best[at], times * count[at])))
            if sum(x.shape[1] for x in held) > 2 * HELD:
                held = [summed(held)]
                if held[0].shape[1] > HELD:
                    yield batch_of(held.pop())
            low = high
    if held:
        yield batch_of(summed(held))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_best, count_sum) of each document, from rows of blocks in the order of blocks; a block at a time is held."""
    now, sums = None, np.zeros((3, BLOCK_DOCS), np.int64)

    def out() -> pa.RecordBatch:
        there = np.flatnonzero(sums[2])
        return pa.record_batch([pa.array(now + there), pa.array(sums[0, there]), pa.array(sums[1, there])], ["key", "n_best", "count_sum"])

    for batch in batches:
        for i, block in enumerate(batch.column(0).to_pylist()):
            if block != now:
                if now is not None:
                    yield out()
                now, sums[:] = block, 0
            docs, n_best, count_sum = (batch.column(k)[i].values.to_numpy() for k in (1, 2, 3))
            sums[0, docs] += n_best  # a row has a document once
            sums[1, docs] += count_sum
            sums[2, docs] = 1
    if now is not None:
        yield out()


def aligned(docs: DataFrame, ranks: str = RANKS, pieces: str = PIECES, shard: int = SHARD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs.

    n_best: links whose pair has the highest count of its A id's pairs; count_sum: the sum of counts over links.
    """
    made = checkpointed(_encoded(docs, ranks, pieces))
    posted = made.filter("a is not null").select("a", "key", "bs", "n_docs", "docs", "times")
    pairs = posted.select("a", F.explode(F.arrays_zip("bs", "n_docs")).alias("p")).groupBy("a", F.col("p.bs").alias("b")).agg(F.sum("p.n_docs").alias("n"))
    # an A id has no more pairs than B has ids
    counts = checkpointed(pairs.groupBy("a").agg(F.collect_list(F.struct("b", "n")).alias("p"), F.sum("n").alias("postings"), F.count(F.lit(1)).alias("kinds")))
    shards = F.ceil(F.col("postings") / F.greatest(F.lit(shard), COPIES * F.col("kinds"))).cast("int")
    split = F.broadcast(counts.select("a", shards.alias("shards")).filter("shards > 1"))  # at most A's vocabulary
    dealt = posted.join(split, "a", "left").withColumn("shard", F.pmod(F.xxhash64("key"), F.coalesce("shards", F.lit(1))).cast("int"))
    copies = counts.select("a", F.lit(None).cast("long").alias("key"), F.col("p.b").alias("bs"), F.col("p.n").alias("n_docs"), F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"))
    empty = F.lit(None)
    rows = dealt.select("a", "key", "bs", F.col("n_docs").cast("array<long>").alias("n_docs"), "docs", "times", "shard").unionByName(copies.select("a", "key", "bs", "n_docs", empty.cast("array<int>").alias("docs"), empty.cast("array<long>").alias("times"), "shard"))
    met = rows.repartition("a", "shard").sortWithinPartitions("a", "shard", F.col("key").asc_nulls_first()).drop("shard")
    given = met.mapInArrow(_given, _GIVEN).repartition("block").sortWithinPartitions("block").mapInArrow(_summed, "key long, n_best long, count_sum long")
    whole = made.filter("a is null").select("key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(given, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
