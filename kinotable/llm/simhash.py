"""Near copies by SimHash, joined exactly around the anchors of a covering code.

A fingerprint has 64 bits; bit i is set if it is set in over half the hashes
of a text's shingles.  Two fingerprints link at 3 or fewer differing bits.

**Anchors.**  The two lower groups of 31 bits are the two sides of a
fingerprint.  Of two fingerprints that link, some side differs in at most one
bit.  On each side the anchors are the words of the Hamming code of length 31,
which covers all words with radius 1.  A fingerprint is at home at the anchor
nearest to it, and is replicated to every anchor within the covering radius
plus the side's threshold, 2: 16 anchors, or 1 for a word of the code.  If two
sides differ in one bit at most, each visits the home of the other, so
comparing those at home with the visitors of each anchor finds every link.

**Compared per anchor.**  Rows are dealt by anchor and streamed in its order.
A group of an anchor gives a star for each of its components, never all pairs.
An anchor at which very many meet is dealt once more: two fingerprints of it
that link agree in one of four groups of the bits of the other side, so these
groups are part of the key, and what still is large is cut into tiles of at
most ``TILE`` rows at home and ``TILE`` visitors, each one key.

Equal fingerprints are one node, so exact copies cost one row each.
Components of the links are found by alternating stars.

Defined cases: a text that is null, empty or without words has fingerprint
zero and links like any other.  A null doc_id has a component like any other
row; component_id is null if no row of a component has a doc_id.  Repeated
rows all stay.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinotable.llm.components import components
from kinotable.llm.saving import checkpointed, dropped

WIDTH, SEED = 3, 42
#: Differing bits of a link (what the two sides of 31 bits and radius 1 are made for).
MOST = 3
#: Bits of a side, and shingles whose bits are counted at once.
SIDE, SHINGLES = 31, 1 << 16
#: Rows of one anchor that are compared without a further key, and rows of a tile.
CROWD, TILE = 4096, 2048
#: Pairs that are compared at once.
PAIRS = 1 << 21


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """The fingerprint of a text; repeated shingles count as often as they come."""
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split()  # of bytes: A-Z alone, and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts, stops = (ends - sizes)[: max(1, len(words) - width + 1)], ends[min(width, len(words)) - 1 :] - 1
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLES):
        hashed = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + SHINGLES].tolist(), stops[at : at + SHINGLES].tolist())]
        counts += np.unpackbits(np.array(hashed, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, bits (the fingerprint as a long) of every row; no shuffle."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(x.as_py() or b"", width, seed) for x in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(bits.view(np.int64))], ["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(of, "doc_id long, bits long")


def syndromes() -> list[list[int]]:
    """For each syndrome s, what to add to a side of that syndrome to come to each anchor within distance 2, the home first.

    The syndrome of a side is the exclusive or of the places, 1 to 31, of its set bits.
    """
    out = [[0]]
    for s in range(1, SIDE + 1):
        pairs = [(i, i ^ s) for i in range(1, SIDE + 1) if i < i ^ s and i ^ s <= SIDE]
        out.append([1 << (s - 1), *((1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs)])
    return out


def _side(bits: Column, k: int) -> Column:
    return F.shiftrightunsigned(bits, k * SIDE).bitwiseAND(F.lit((1 << SIDE) - 1))


def _syndrome(side: Column) -> Column:
    """Its five bits are parities of masked bits."""
    masks = [sum(1 << (p - 1) for p in range(1, SIDE + 1) if p >> k & 1) for k in range(5)]
    parts = [F.shiftleft((F.bit_count(side.bitwiseAND(F.lit(m))) % 2).cast("int"), k) for k, m in enumerate(masks)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.bitwiseOR(part)
    return whole


def visits(nodes: DataFrame) -> DataFrame:
    """(side, anchor, bits, home): each of ``nodes`` (bits) at all anchors that it visits."""
    text = ";".join(",".join(map(str, x)) for x in syndromes())
    table = F.transform(F.split(F.lit(text), ";"), lambda x: F.split(x, ",").cast("array<long>"))
    sides = nodes.select("bits", F.posexplode(F.array(*[_side(F.col("bits"), k) for k in (0, 1)])).alias("side", "own"))
    each = sides.select("bits", "side", "own", F.posexplode(F.element_at(table, _syndrome(F.col("own")) + 1)).alias("place", "delta"))
    return each.select("side", F.col("own").bitwiseXOR(F.col("delta")).alias("anchor"), "bits", (F.col("place") == 0).alias("home"))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links a-b, but the least of its component, with that: as many links as a spanning forest has."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[x], least[y])
        before = least.copy()
        for end in (x, y, before[x], before[y]):
            np.minimum.at(least, end, low)
        least = least[least]
        if (least == before).all():
            break
    own = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[own], nodes[least[own]]


def _compared(home: np.ndarray, visitor: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each ``home[i]`` with the visitors from ``first[i]`` on, ``n[i]`` of them; as stars, found in pieces of PAIRS."""
    links_a, links_b, ends = [], [], np.cumsum(n)
    low, count = 0, len(home)
    while low < count:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
        sizes = n[low:high]
        who = np.repeat(np.arange(low, high), sizes)
        at = np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[who]
        x, y = home[who], visitor[at]
        near = (np.bitwise_count(x ^ y) <= MOST) & (x != y)
        x, y = _stars(x[near], y[near])
        links_a.append(x)
        links_b.append(y)
        low = high
    if not links_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _stars(np.concatenate(links_a), np.concatenate(links_b))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, home, bits) in the order of keys, and of a key those at home first."""

    def found(key: np.ndarray, home: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(at, len(key)))
        group = np.repeat(np.arange(len(at)), sizes)
        mine = np.flatnonzero(home)
        a, b = _compared(bits[mine], bits, at[group[mine]], sizes[group[mine]])
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)))
        key, home, bits = (np.concatenate(x) for x in zip(*held))
        end = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0  # the last key may go on
        yield found(key[:end], home[:end], bits[:end])
        held = [(key[end:], home[end:], bits[end:])]
    if held:
        yield found(*held[0])


def _dealt(visiting: DataFrame, crowd: int, tile: int) -> DataFrame:
    """(key, home, bits) of visiting rows; those of a crowded anchor have smaller groups of the same links."""
    anchor = F.col("anchor") * 2 + F.col("side")
    sized = visiting.groupBy("side", "anchor").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"))
    crowded = checkpointed(sized.filter((F.col("n") > crowd) & (F.col("homes") > 0)).select("side", "anchor"))
    if crowded.isEmpty():
        return visiting.select(anchor.alias("key"), "home", "bits")
    plain = visiting.join(crowded, ["side", "anchor"], "left_anti").select(anchor.alias("key"), "home", "bits")
    # the other side and the two bits above: 33 bits in four groups, one of which agrees
    bits = F.col("bits")
    rest = F.when(F.col("side") == 0, F.shiftrightunsigned(bits, SIDE)).otherwise(_side(bits, 0).bitwiseOR(F.shiftleft(F.shiftrightunsigned(bits, 2 * SIDE), SIDE)))
    group = lambda k: F.shiftrightunsigned(rest, 8 * k).bitwiseAND(F.lit(0x1FF if k == 3 else 0xFF)) * 4 + k
    parted = visiting.join(crowded, ["side", "anchor"], "left_semi").select("side", "anchor", "bits", "home", F.explode(F.array(*map(group, range(4)))).alias("part"))
    keys = ["side", "anchor", "part"]
    tiles = parted.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    parted = parted.join(tiles, keys)
    mine = F.pmod(F.xxhash64("bits"), F.col("tiles")).cast("int")
    across = F.sequence(F.lit(0), F.col("tiles") - 1)
    # a row at home is in the tiles of its line, a visitor in those of its column
    homes = parted.filter("home").select(*keys, F.lit(True).alias("home"), "bits", mine.alias("line"), F.explode(across).alias("column"))
    guests = parted.select(*keys, F.lit(False).alias("home"), "bits", F.explode(across).alias("line"), mine.alias("column"))
    cut = homes.unionByName(guests).select(F.xxhash64(*keys, "line", "column").alias("key"), "home", "bits")
    return plain.unionByName(cut)


def links(nodes: DataFrame, crowd: int = CROWD, tile: int = TILE) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``nodes`` (bits) from which all components follow."""
    rows = _dealt(visits(nodes), crowd, tile)
    return rows.repartition("key").sortWithinPartitions("key", F.col("home").desc()).mapInArrow(_links, "a long, b long")


def near_copies(docs: DataFrame, width: int = WIDTH, seed: int = SEED, crowd: int = CROWD, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links) of every row of docs."""
    rows = checkpointed(fingerprints(docs, width, seed))
    nodes = checkpointed(rows.groupBy("bits").agg(F.min("doc_id").alias("least")))
    found = checkpointed(links(nodes.select("bits"), crowd, tile))
    roots = components(found)
    dropped(found)
    named = nodes.join(roots.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_bits = named.select("bits", "root").join(least, "root").select("bits", "component_id")
    return rows.join(by_bits, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
