"""Mixing sources to target weights, by Pfair scheduling.

Each source's documents, in a fixed pseudo-random order, are cut into blocks
of ``block_docs``.  With weight w, block j of a source is released at slot
floor(j / w) and due before slot ceil((j + 1) / w); in each slot the released
block with the earliest deadline goes first (ties: the heavier source, then the
first by name).  Weights are whole numbers in the exact ratio of the targets
and all slots of a phase are scheduled with them, so every block meets its
deadline, and after any number of slots each source has had its target
weight's share to within less than one block.  Only if ``period`` is given are
weights rounded, to whole parts of it, and the bound is to the rounded ones.

No row is dropped or repeated: when a source runs out, the phase ends in that
slot, and the weights of the sources that are left are scaled up for the next
phase, in which the bound holds anew.

The driver sees the number of documents of each source and nothing else.  It
walks the schedule once and keeps its state at the start of each window of
slots, within a bound that depends on the number of sources alone; tasks go on
from these states and give the slots of the blocks.  The walk itself takes
about a microsecond for a block.  A source's order is numbered by ranges of its
hash, more of them the more rows it has, so a source that holds most rows is
numbered by many tasks.

Defined cases: a null source is a source of its own, which comes last; text is
not looked at, so null and very long texts are like others; repeated rows are
each scheduled; an empty table gives no rows; sources without a target weight
raise an error if weights are given, and so do more than ``max_sources`` if
that is given, and more sources than parts of a given ``period``.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Documents in a block; hash ranges that number a source, at least, and rows of one source in a range, about.
BLOCK_DOCS, RANGES, RANGE_ROWS = 16, 256, 1 << 20
#: Blocks in a row of the schedule; most rows of short tables that are broadcast, and most blocks of a schedule that is (12 bytes each).
CHUNK, BROADCAST_ROWS, BROADCAST_BLOCKS = 1024, 200_000, 2_000_000
#: Slots between two states of the schedule that the driver keeps, and bytes of these states, about.
WINDOW, CHECKPOINT_BYTES = 1 << 16, 1 << 26
#: Default weights: shares of documents to this power.
TEMPERATURE = 0.7

_OWN = ["__mix_rank", "__mix_block", "__mix_slot", "__mix_phase"]


def whole_parts(weights: list[float], period: int) -> list[int]:
    """Whole numbers, 1 at least, that add up to the period, by largest remainder."""
    w = np.array(weights, float)
    w = w / w.sum() * (period - len(w))
    parts = np.floor(w).astype(int)
    for i in np.argsort(-(w - parts), kind="stable")[: period - len(w) - parts.sum()]:
        parts[i] += 1
    return (parts + 1).tolist()


def one_period(parts: list[int]) -> list[int]:
    """The source of each slot: earliest deadline first among released blocks."""
    period = sum(parts)
    released: list[list[tuple[int, int]]] = [[] for _ in range(period)]
    for s, c in enumerate(parts):
        for j in range(c):
            released[j * period // c].append((-(-(j + 1) * period // c), s))
    ready: list[tuple[int, int]] = []
    out = []
    for t in range(period):
        for block in released[t]:
            heapq.heappush(ready, block)
        due, s = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a block missed its deadline")
        out.append(s)
    return out


def whole_weights(weights: Sequence[float]) -> list[int]:
    """Whole numbers in the exact ratio of the weights."""
    exact = [Fraction(w) for w in weights]
    scale = lcm(*(w.denominator for w in exact))
    return [int(w * scale) for w in exact]


class Schedule:
    """Earliest deadline first over all phases, which may stop after any slot and go on elsewhere from ``left`` and ``had``.

    ``left`` are the blocks that each source still has, ``had`` those that it
    was given in this phase, ``t`` the slots of the phase so far.  A step takes
    the logarithm of the number of sources: sources that have not been served
    in a phase stand in order of weight, which is that of their first
    deadlines, and only the others are in heaps.
    """

    def __init__(self, left: Sequence[int], weights: Sequence[float], period: int | None = None, had: Sequence[int] | None = None, t: int = 0, phase: int = 0, slot: int = 0):
        self.left, self.weights, self.period = list(left), weights, period
        self.whole = None if period else whole_weights(weights)
        self.had, self.t, self.phase, self.slot = list(had) if had is not None else [0] * len(self.left), t, phase, slot
        self._arranged()

    def _arranged(self) -> None:
        live = [s for s, n in enumerate(self.left) if n]
        if self.period and live:
            parts = whole_parts([self.weights[s] for s in live], self.period)
            self.w, self.total = dict(zip(live, parts)), self.period
        else:
            self.w = {s: self.whole[s] for s in live} if live else {}
            self.total = sum(self.w.values())
        self.order = sorted(live, key=lambda s: (-self.w[s], s))
        self.later: list[tuple[int, int]] = []
        self.ready: list[tuple[int, int]] = []
        self.fresh = 0
        for k, s in enumerate(self.order):
            if self.had[s]:  # these come first in the order
                self.fresh = k + 1
                heapq.heappush(self.later, (self.had[s] * self.total // self.w[s], k))

    def run(self, slots: int) -> tuple[array, list[tuple[int, int]]]:
        """The sources of the next slots, fewer if all blocks are placed, and (slot, phase) of each phase that begins among them."""
        out, begun = array("i"), []
        while self.order and len(out) < slots:
            if not self.t:
                begun.append((self.slot, self.phase))
            order, had, w, total, later, ready = self.order, self.had, self.w, self.total, self.later, self.ready
            while len(out) < slots:
                while later and later[0][0] <= self.t:
                    k = heapq.heappop(later)[1]
                    heapq.heappush(ready, (-(-(had[order[k]] + 1) * total // w[order[k]]), k))
                new = (-(-total // w[order[self.fresh]]), self.fresh) if self.fresh < len(order) else None
                if new is not None and (not ready or new < ready[0]):
                    due, k = new
                    self.fresh += 1
                else:
                    due, k = heapq.heappop(ready)
                if due <= self.t:
                    raise AssertionError("a block missed its deadline")
                s = order[k]
                out.append(s)
                self.t += 1
                self.slot += 1
                self.left[s] -= 1
                had[s] += 1
                if not self.left[s]:
                    self.had, self.t, self.phase = [0] * len(self.left), 0, self.phase + 1
                    self._arranged()
                    break
                heapq.heappush(later, (had[s] * total // w[s], k))
        return out, begun


def schedule(blocks: Sequence[int], weights: Sequence[float], period: int | None = None) -> tuple[array, list[int]]:
    """The source of each slot, and the first slot of each phase."""
    out, begun = Schedule(blocks, weights, period).run(sum(blocks))
    return out, [slot for slot, _ in begun]


def checkpoints(blocks: Sequence[int], weights: Sequence[float], period: int | None = None, window: int = WINDOW, most: int = CHECKPOINT_BYTES) -> list[tuple]:
    """(slot, slots, phase, t, left, had) at the start of each window of slots: what a task needs to go on from there.

    Windows become longer, twice as long each time, where they would take more
    than ``most`` bytes, so the driver's memory depends on the number of
    sources alone.
    """
    own, out = Schedule(blocks, weights, period), []
    while own.order:
        if len(out) >= max(2, most // (16 * len(blocks))):
            out, window = out[::2], 2 * window
            if own.slot % window:  # in the middle of a window that is longer now
                own.run(window - own.slot % window)
                continue
        out.append((own.slot, own.phase, own.t, np.array(own.left, np.int64).tobytes(), np.array(own.had, np.int64).tobytes()))
        own.run(window)
    ends = [x[0] for x in out[1:]] + [own.slot]
    return [(slot, end - slot, *rest) for (slot, *rest), end in zip(out, ends)]


def _plan(spark: SparkSession, names: list[str | None], blocks: list[int], weights: list[float], period: int | None) -> DataFrame:
    """(source, chunk, slots, phases): the slot and phase of each block, CHUNK blocks of a source in a row; tasks run the windows."""
    starts = checkpoints(blocks, weights, period)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    made = pa.table([pa.array([x[i] for x in starts], k) for i, k in enumerate(kinds)], ["slot", "slots", "phase", "t", "left", "had"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot, slots, phase, t, left, had in zip(*(c.to_pylist() for c in batch.columns)):
                left, had = np.frombuffer(left, np.int64), np.frombuffer(had, np.int64).tolist()
                out, begun = Schedule(left.tolist(), weights, period, had, t, phase, slot).run(slots)
                source = np.frombuffer(out, np.int32)
                edges = np.array([s for s, _ in begun], np.int64)
                phases = phase + np.searchsorted(edges, slot + np.arange(len(source)), "right") - (1 if begun and begun[0][0] == slot else 0)
                order = np.argsort(source, kind="stable")
                mine = source[order]
                first = np.flatnonzero(np.diff(mine, prepend=-1))
                block = np.array(blocks, np.int64)[mine] - left[mine] + np.arange(len(mine)) - np.repeat(first, np.diff(first, append=len(mine)))
                cut = np.flatnonzero(np.diff(mine, prepend=-1) | np.diff(block // CHUNK, prepend=-1))
                lists = pa.array(np.append(cut, len(mine)), pa.int32())
                yield pa.record_batch(
                    [pa.array([names[s] for s in mine[cut]], pa.string()), pa.array(block[cut] // CHUNK), pa.array(block[cut]), pa.ListArray.from_arrays(lists, pa.array(slot + order)), pa.ListArray.from_arrays(lists, pa.array(phases[order].astype(np.int32)))],
                    ["source", "chunk", "block", "slots", "phases"],
                )

    ran = spark.createDataFrame(made).repartition(max(1, min(len(starts), 2000)), "slot").mapInArrow(run, "source string, chunk long, block long, slots array<long>, phases array<int>")
    pieces = F.array_sort(F.collect_list(F.struct("block", "slots", "phases")))
    joined = ran.groupBy("source", "chunk").agg(pieces.alias("p"))
    return joined.select("source", "chunk", F.flatten(F.transform("p", lambda x: x["slots"])).alias("slots"), F.flatten(F.transform("p", lambda x: x["phases"])).alias("phases"))


def _sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _scheduled(docs: DataFrame, weights: Mapping[str, float] | None, temperature: float, block_docs: int, period: int | None, max_sources: int | None) -> DataFrame:
    """docs with rank, block, slot and phase added under names of their own."""
    most = min((n for n in (max_sources, period) if n is not None), default=None)
    counted = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    counted = (counted if most is None else counted.limit(most + 1)).collect()
    if most is not None and len(counted) > most:
        raise ValueError(f"more than {most} sources")
    counted.sort(key=lambda r: (r.source is None, str(r.source)))
    if weights is not None and (missing := [r.source for r in counted if weights.get(r.source, 0) <= 0]):
        raise ValueError(f"no target weight for {missing[:5]}")
    names = [r.source for r in counted]
    target = [weights[s] for s in names] if weights is not None else [r.n**temperature for r in counted]
    blocks = [-(-r.n // block_docs) for r in counted]
    plan = _plan(docs.sparkSession, names, blocks, target, period)
    # of a source's rows a range holds about RANGE_ROWS at most
    ranges = max(RANGES, 1 << (max((r.n for r in counted), default=0) // RANGE_ROWS).bit_length())
    keyed = docs.withColumn("__mix_hash", F.xxhash64("doc_id", "text")).withColumn("__mix_range", F.pmod(F.shiftrightunsigned("__mix_hash", 40), F.lit(ranges)).cast("int"))
    sizes = keyed.groupBy("source", "__mix_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("__mix_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("source").alias("__mix_o_source"), F.col("__mix_range").alias("__mix_o_range"), before.alias("__mix_o_before"))
    inside = F.row_number().over(Window.partitionBy("source", "__mix_range").orderBy("__mix_hash", "doc_id")) - 1
    ranked = keyed.withColumn("__mix_rank", inside).join(_sized(offsets, len(names) * ranges), F.col("source").eqNullSafe(F.col("__mix_o_source")) & (F.col("__mix_range") == F.col("__mix_o_range")))
    ranked = ranked.withColumn("__mix_rank", F.col("__mix_rank") + F.col("__mix_o_before")).drop("__mix_o_source", "__mix_o_range", "__mix_o_before", "__mix_hash", "__mix_range")
    ranked = ranked.withColumn("__mix_block", F.expr(f"__mix_rank div {int(block_docs)}"))
    plan = plan.select(*[F.col(c).alias(f"__mix_p_{c}") for c in plan.columns])
    met = ranked.join(F.broadcast(plan) if sum(blocks) <= BROADCAST_BLOCKS else plan, F.col("source").eqNullSafe(F.col("__mix_p_source")) & (F.expr(f"__mix_block div {CHUNK}") == F.col("__mix_p_chunk")))
    place = f"cast(__mix_block % {CHUNK} as int)"
    return met.withColumn("__mix_slot", F.expr(f"__mix_p_slots[{place}]")).withColumn("__mix_phase", F.expr(f"__mix_p_phases[{place}]")).drop(*plan.columns)


def mixed_order(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, block_docs: int = BLOCK_DOCS, period: int | None = None, max_sources: int | None = None) -> DataFrame:
    """doc_id, source, source_rank, block, slot, phase of every row.

    Sorted by slot and source_rank the rows are the mixture.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text"))
    out = _scheduled(narrow, weights, temperature, block_docs, period, max_sources)
    return out.select("doc_id", "source", *[F.col(a).alias(b) for a, b in zip(_OWN, ("source_rank", "block", "slot", "phase"))])


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, block_docs: int = BLOCK_DOCS, period: int | None = None, max_sources: int | None = None) -> DataFrame:
    """docs, all rows and columns, dealt out and sorted in the order of the mixture."""
    out = _scheduled(docs, weights, temperature, block_docs, period, max_sources)
    return out.repartitionByRange("__mix_slot", "__mix_rank").sortWithinPartitions("__mix_slot", "__mix_rank").select(*[F.col(f"`{c}`") for c in docs.columns])
