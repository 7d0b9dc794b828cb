"""Suffix-array dedup: repeated byte strings, by a common-prefix-aware merge sort.

A byte goes if a string of LENGTH bytes that covers it also starts earlier.
To keep the suffix array small it is sparse.  Each window of LENGTH bytes
points to one anchor, the gram of GRAM bytes in it with the least hash, so
equal windows have their anchors at equal places and only suffixes that start
at anchors are sorted, each with the bytes on its left that its windows reach.

1. The cluster counts the anchors' hashes; those that occur twice set bits in
   an array of fixed size.  Suffixes without their bit have no equal and stay
   where they are.  (A full bit array lets more suffixes through, nothing else.)
2. Each task sorts its suffixes, SENT at a time, settles what repeats among
   them, and sends the rest as front-coded sorted runs, dealt by range of the
   sort key.  There are as many ranges as the counted suffixes need.
3. Each range merges its runs with a loser tree that compares from the known
   common prefix on and yields the common-prefix lengths of the merged order.
4. Two windows are equal if their suffixes share enough bytes to the right and
   their left sides enough to the left.  Both are read from the common-prefix
   lengths, for all suffixes of a range at once; in each class of equal windows
   all but the earliest repeat.

Tasks hold SENT suffixes of a batch of texts, or the runs of one range.
Repeats among these are settled before anything is sent, so a passage that
fills a third of the corpus arrives about once from each SENT suffixes.

Defined cases: null and empty texts have no bytes; texts are taken as their
bytes, whatever they hold; rows with a null doc_id come after all others; rows
with the same doc_id come in the order of their texts' hashes, and rows that
agree in both are one document, so each of them gets what that document gets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinotable.llm.hashing import CHUNK_BYTES, buffers, chunks, mix, running_sum, span_hashes
from kinotable.llm.saving import checkpointed, tidily

#: Bytes of a repeated string, and of the gram that anchors it.
LENGTH, GRAM = 100, 32
#: Bits that tell which anchors occur twice.
BITS = 1 << 26
#: Suffixes that are compared at once, that a task sorts before it sends them, and that a range is planned for.
SLICE, SENT, RANGE = 40_000, 75_000, 150_000
#: Bytes of text whose anchors are sought at once.
PIECE = CHUNK_BYTES // 2

_U = np.uint64
_LEFT = LENGTH - GRAM
_LAST = np.iinfo(np.int64).max


def _pieces(buf: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, text number, place in its text) of groups of pieces of about ``limit`` bytes.

    A longer text is cut into pieces that overlap by LENGTH - 1 bytes.
    """
    held: list[tuple[int, int, int]] = []
    size = 0

    def group():
        parts = [buf[a:b] for _, a, b in held]
        at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return np.concatenate(parts), at, np.array([i for i, _, _ in held]), np.array([a - offsets[i] for i, a, _ in held])

    for i in range(len(offsets) - 1):
        for a in range(int(offsets[i]), int(offsets[i + 1]) - LENGTH + 1, limit):
            b = min(int(offsets[i + 1]), a + limit + LENGTH - 1)
            held.append((i, a, b))
            size += b - a
            if size >= limit:
                yield group()
                held, size = [], 0
    if held:
        yield group()


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    blocks = np.concatenate((x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, its hash, first and last window that point to it, and its piece."""
    n = len(buf)
    start = np.arange(n - GRAM + 1)
    h = span_hashes(running_sum(buf), start, start + GRAM)
    mask = _U((1 << n.bit_length()) - 1)
    least = _sliding_least((h & ~mask) | start.astype(np.uint64), LENGTH - GRAM + 1)
    piece = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - LENGTH + 1]
    window = np.flatnonzero(offsets[1:][piece] - np.arange(n - LENGTH + 1) >= LENGTH)
    anchor = (least[window] & mask).astype(np.int64)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)))
    last = np.append(new[1:], len(window)) - 1
    return anchor[new], h[anchor[new]], window[new], window[last], piece[window[new]]


def _sort_order(h: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """By hash, then bytes to the right, then length; bytes are looked at only among equal hashes."""
    order = np.argsort(h, kind="stable")
    hs = h[order]
    tied = np.zeros(len(h), bool)
    tied[1:] = hs[1:] == hs[:-1]
    tied[:-1] |= tied[1:]
    at = np.flatnonzero(tied)
    if len(at):
        rows = order[at]
        order[at] = rows[np.lexsort([size[rows], *_columns(right[rows])[::-1], h[rows]])]
    return order


def _columns(x: np.ndarray) -> list[np.ndarray]:
    wide = np.zeros((len(x), -(-x.shape[1] // 8) * 8), np.uint8)
    wide[:, : x.shape[1]] = x
    big = wide.view(">u8").astype(np.uint64)
    return [np.ascontiguousarray(big[:, k]) for k in range(big.shape[1])]


def _common(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common-prefix length of each row with the one before; 0 for the first."""
    out = np.zeros(len(x), np.int64)
    if len(x) > 1:
        differ = x[1:] != x[:-1]
        first = np.where(differ.any(1), differ.argmax(1), x.shape[1])
        out[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return out


def _ranks(doc: np.ndarray, tie: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The place of each suffix in the corpus; equal for the same start in repeated rows."""
    order = np.lexsort((at, tie, doc))
    new = np.zeros(len(at), bool)
    for x in (doc, tie, at):
        new[1:] |= x[order][1:] != x[order][:-1]
    rank = np.empty(len(at), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _settle(common: np.ndarray, left: np.ndarray, near: np.ndarray, far: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest window offset that repeats (near > far: none), and whether a window is the earliest.

    Rows stand in suffix order; ``common`` are common-prefix lengths, ``left``
    the reversed bytes before each anchor, near..far the offsets of its windows,
    ``rank`` the place of the suffix in the corpus.  Rows of equal rank are one
    start, of which none repeats another.
    """
    n = len(common)
    lo, hi, fresh = np.full(n, LENGTH), np.full(n, -1), np.zeros(n, bool)
    group = np.cumsum(common < GRAM)
    alone = np.bincount(group, minlength=n + 1)[group] == 1
    fresh[alone] = True
    rows = np.flatnonzero(~alone)
    if not len(rows):
        return lo, hi, fresh
    common, left, near_, far_, group = common[rows], left[rows], near[rows], far[rows], group[rows]
    by_left = np.lexsort([far_, *_columns(left)[::-1], group])  # at equal bytes the shorter side first
    shared = _common(left[by_left], far_[by_left])
    shared[np.append(True, group[by_left][1:] != group[by_left][:-1])] = -1
    by_rank = np.argsort(rank[rows], kind="stable")
    near_, far_, ranked = near_[by_rank], far_[by_rank], rank[rows][by_rank]
    m, left_class = len(rows), np.zeros(len(rows), np.int64)
    low, high, first = np.full(m, LENGTH), np.full(m, -1), np.zeros(m, bool)
    for o in range(int(near_.min()), int(far_.max()) + 1):
        on = np.flatnonzero((near_ <= o) & (o <= far_))
        if not len(on):
            continue
        left_class[by_left] = np.cumsum(shared < o)
        pair = (np.cumsum(common < LENGTH - o) * (m + 1) + left_class)[by_rank][on]
        order = np.argsort(pair, kind="stable")
        lead = np.append(True, pair[order][1:] != pair[order][:-1])
        first[on[order[lead]]] = True
        earliest = ranked[on[order[lead]]][np.cumsum(lead) - 1]
        again = on[order[ranked[on[order]] > earliest]]
        low[again] = np.minimum(low[again], o)
        high[again] = np.maximum(high[again], o)
    back = rows[by_rank]
    lo[back], hi[back], fresh[back] = low, high, first
    return lo, hi, fresh


def _encode(h, right, size, left, near, far, doc, tie, at) -> bytes:
    """A sorted run: counts, common-prefix lengths, then the bytes that are new in each suffix."""
    n = len(h)
    common = _common(right, size)
    common[1:][h[1:] != h[:-1]] = 0
    there = np.arange(right.shape[1])
    tails = right[(there >= common[:, None]) & (there < size[:, None])]
    sides = left[np.arange(left.shape[1]) < far[:, None]]
    parts = [np.array([n, len(tails), len(sides)], "<i8"), h.astype("<u8"), doc.astype("<i8"), tie.astype("<i8"), at.astype("<i8"), common.astype(np.uint8), size.astype(np.uint8), near.astype(np.uint8), far.astype(np.uint8), tails, sides]
    return b"".join(p.tobytes() for p in parts)


class _Run:
    """A decoded run; ``keys`` are hash and bytes to the right, rebuilt from the front coding."""

    def __init__(self, raw: bytes):
        n, n_tails, n_sides = np.frombuffer(raw, "<i8", 3).tolist()
        at = 24
        fields = []
        for kind, count in (("<u8", n), ("<i8", n), ("<i8", n), ("<i8", n), ("u1", n), ("u1", n), ("u1", n), ("u1", n), ("u1", n_tails), ("u1", n_sides)):
            fields.append(np.frombuffer(raw, kind, count, at))
            at += fields[-1].nbytes
        self.h, self.doc, self.tie, self.at, common, self.size, self.near, self.far, tails, sides = fields
        self.left = np.zeros((n, _LEFT), np.uint8)
        self.left[np.arange(_LEFT) < self.far[:, None]] = sides
        apart = np.append(_U((1 << 64) - 1), self.h[1:] ^ self.h[:-1])
        leading = sum((apart < _U(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        self.common = np.where(apart == 0, 8 + common.astype(np.int64), leading).tolist()
        tails, before, where = tails.tobytes(), b"", 0
        self.keys = []
        for head, c, s in zip(self.h.astype(">u8").view("S8").tolist(), common.tolist(), self.size.tolist()):
            before = before[:c] + tails[where : where + s - c]
            where += s - c
            self.keys.append(head.ljust(8, b"\0") + before)


def merge_runs(keys: list[list[bytes]], common: list[list[int]]) -> Iterator[tuple[int, int, int]]:
    """(run, place, common prefix with the one before) in sorted order.

    A loser tree: each loser keeps its common prefix with the winner that beat
    it, so two keys are compared from their known common prefix on, and not at
    all when these differ.  ``common``: the exact common prefixes of neighbours
    in a run.
    """
    width = 1 << max(0, len(keys) - 1).bit_length()
    place = [0] * width
    head = [k[0] if k else None for k in keys] + [None] * (width - len(keys))
    known = [0 if x is not None else -1 for x in head]

    def beats(a: int, b: int) -> int:
        """The winner of a and b; the loser learns its common prefix with it."""
        ka, kb = known[a], known[b]
        if ka != kb or ka < 0:
            return a if ka >= kb else b
        x, y, i = head[a], head[b], ka
        n = min(len(x), len(y))
        while i < n and x[i : i + 16] == y[i : i + 16]:
            i += 16
        i = min(i, n)
        while i < n and x[i] == y[i]:
            i += 1
        if i < n and x[i] < y[i] or i == n and len(x) <= len(y):
            known[b] = i
            return a
        known[a] = i
        return b

    tree, level = [0] * width, list(range(width))
    at = width // 2
    while len(level) > 1:
        wins = []
        for k in range(0, len(level), 2):
            w = beats(level[k], level[k + 1])
            tree[at + k // 2] = level[k] + level[k + 1] - w
            wins.append(w)
        level, at = wins, at // 2
    best = level[0]
    while head[best] is not None:
        yield best, place[best], known[best]
        place[best] += 1
        i = place[best]
        if i < len(keys[best]):
            head[best], known[best] = keys[best][i], common[best][i]
        else:
            head[best], known[best] = None, -1
        node = (best + width) // 2
        while node:
            other = tree[node]
            if known[best] > known[other]:
                pass
            elif known[best] < known[other]:
                tree[node], best = best, other
            else:
                w = beats(best, other)
                if w != best:
                    tree[node], best = best, other
            node //= 2


_MADE = "range int, run binary, doc_id long, tie long, start long, stop long"


def _made(runs: list[tuple[int, bytes]], doc=(), tie=(), start=(), stop=(), ranges: int = 1) -> pa.RecordBatch:
    """Runs, and removed spans, which pass through a range picked by document."""
    r, n = len(runs), len(doc)
    none = lambda k: [None] * k
    columns = [
        pa.array([x for x, _ in runs] + (np.asarray(doc, np.int64) % ranges).tolist(), pa.int32()),
        pa.array([x for _, x in runs] + none(n), pa.binary()),
        *(pa.array(none(r) + np.asarray(c, np.int64).tolist(), pa.int64()) for c in (doc, tie, start, stop)),
    ]
    return pa.record_batch(columns, [x.split()[0] for x in _MADE.split(", ")])


def _span(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows at offsets lo..hi of an anchor overlap, so they cover one span."""
    return at - hi, at - lo + LENGTH


def _twice(docs: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """Bit array of the anchor hashes that occur more than once, and how many anchors have these."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = buffers(batch.column(2))
            held, size = [], 0
            for b, o, _, _ in _pieces(buf, offsets, PIECE):
                held.append(_anchors(b, o)[1])
                size += len(held[-1])
                if size >= 2 * SENT:
                    yield counted(held)
                    held, size = [], 0
            if held:
                yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    often = docs.mapInArrow(hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    bit = F.pmod("h", F.lit(bits))
    with tidily(docs.sparkSession):
        packed = often.select(bit.alias("bit"), "n").groupBy(F.floor(F.col("bit") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"), F.sum("n").alias("n")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[packed.column("w").to_numpy()] = packed.column("bits").to_numpy()
    return held, int(packed.column("n").to_numpy().sum())


def repeated_spans(docs: DataFrame, ranges: int | None = None, bits: int = BITS) -> DataFrame:
    """(doc_id, tie, start, stop): spans of bytes to remove, which may overlap.

    docs: doc_id (long, none null), tie (long), text (binary); documents are in
    the order of doc_id and tie, which name one document together.
    """
    twice, n_suffixes = _twice(docs, bits)
    ranges = ranges or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_suffixes // RANGE))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie = (batch.column(k).to_numpy() for k in (0, 1))
            buf, offsets = buffers(batch.column(2))
            found: list[tuple[np.ndarray, ...]] = []
            size = 0
            for b, o, owner, place in _pieces(buf, offsets, PIECE):
                found.append(suffixes(b, o, doc[owner], tie[owner], place))
                size += len(found[-1][0])
                if size >= SENT:
                    yield sorted_runs(found)
                    found, size = [], 0
            if size:
                yield sorted_runs(found)

    def suffixes(b, o, doc, tie, place) -> tuple[np.ndarray, ...]:
        """Hash, bytes to the right and their number, bytes to the left, near, far, document and place of the suffixes that may repeat."""
        anchor, h, first, last, piece = _anchors(b, o)
        bit = (h.view(np.int64) % bits).astype(np.int64)
        some = np.flatnonzero((twice[bit >> 6].view(np.uint64) >> (bit & 63).astype(np.uint64)) & _U(1))
        anchor, h, first, last, piece = (x[some] for x in (anchor, h, first, last, piece))
        size, far, there, side = last + LENGTH - anchor, anchor - first, np.arange(LENGTH), np.arange(_LEFT)
        right = np.where(there < size[:, None], b[np.minimum(anchor[:, None] + there, len(b) - 1)], np.uint8(0))
        left = np.where(side < far[:, None], b[np.maximum(anchor[:, None] - 1 - side, 0)], np.uint8(0))
        # anchors have the least hashes of their windows; mixed again, they are even over all ranges
        return mix(h), right, size, left, anchor - last, far, doc[piece], tie[piece], anchor - o[piece] + place[piece]

    def sorted_runs(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """Front-coded runs by range, and the spans that repeat among these suffixes."""
        h, right, size, left, near, far, ids, ties, at = (np.concatenate(x) for x in zip(*found))
        order = _sort_order(h, right, size)
        h, right, size, left, near, far, ids, ties, at = (x[order] for x in (h, right, size, left, near, far, ids, ties, at))
        common = _common(right, size)
        common[1:][h[1:] != h[:-1]] = 0
        lo, hi, fresh = _settle(common, left, near, far, _ranks(ids, ties, at))
        again = hi >= 0
        start, stop = _span(at[again], lo[again], hi[again])
        h, right, size, left, near, far, i, t, a = (x[fresh] for x in (h, right, size, left, near, far, ids, ties, at))
        part = ((h >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
        edge = np.searchsorted(part, np.arange(ranges + 1))
        runs = [(k, _encode(*(x[edge[k] : edge[k + 1]] for x in (h, right, size, left, near, far, i, t, a)))) for k in np.unique(part).tolist()]
        return _made(runs, ids[again], ties[again], start, stop, ranges)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["doc_id", "tie", "start", "stop"], {}
        for batch in batches:
            spans = batch.filter(pa.compute.is_null(batch.column("run")))
            if spans.num_rows:
                yield spans.select(names)
            for r, raw in zip(batch.column("range"), batch.column("run")):
                if raw.is_valid:
                    held.setdefault(r.as_py(), []).append(raw.as_py())
        for r in sorted(held):
            runs = [_Run(raw) for raw in held.pop(r)]
            base = np.concatenate(([0], np.cumsum([len(x.keys) for x in runs])))
            whole = {f: np.concatenate([getattr(x, f) for x in runs]) for f in ("left", "near", "far", "doc", "tie", "at")}
            row, known = [], []
            for k, i, c in merge_runs([x.keys for x in runs], [x.common for x in runs]):
                if len(row) >= SLICE and c < 8 + GRAM:
                    yield settled(whole, row, known, names)
                    row, known = [], []
                row.append(base[k] + i)
                known.append(c)
            if row:
                yield settled(whole, row, known, names)

    def settled(whole, row, known, names) -> pa.RecordBatch:
        row = np.array(row)
        left, near, far, doc, tie, at = (whole[f][row] for f in ("left", "near", "far", "doc", "tie", "at"))
        common = np.maximum(np.array(known) - 8, 0)
        common[0] = 0
        lo, hi, _ = _settle(common, left, near.astype(np.int64), far.astype(np.int64), _ranks(doc, tie, at))
        again = hi >= 0
        start, stop = _span(at[again], lo[again], hi[again])
        return pa.record_batch([pa.array(x) for x in (doc[again], tie[again], start, stop)], names)

    return docs.mapInArrow(send, _MADE).repartitionById(ranges, F.col("range")).mapInArrow(receive, "doc_id long, tie long, start long, stop long")


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, ranges: int | None = None, bits: int = BITS, whole: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary), removed (spans) of every row of docs.

    ``kept`` is null if not ``whole``, for those who need no texts.
    """
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(raw).alias("tie"), raw.alias("text"), F.col("doc_id").cast("long").alias("own_id"))
    spans = repeated_spans(plain.select("doc_id", "tie", "text"), ranges, bits)
    each = checkpointed(spans.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    rows = plain.join(each, ["doc_id", "tie"], "left").select("own_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in (x.slice(a, b - a) for x in batches for a, b in chunks(buffers(x.column(1))[1], 4 * CHUNK_BYTES)):
            out: list[list] = [[] for _ in range(6)]
            for text, held in zip(batch.column(1), batch.column(2).to_pylist()):
                text, removed = text.as_py(), _joined([(s["start"], s["stop"]) for s in held or ()])
                edges = [0, *(x for span in removed for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for c, x in zip(out, (len(text), len(text) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), kept if whole else None, [{"start": a, "stop": b} for a, b in removed])):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), kind]
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"])

    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<start:long,stop:long>>")
