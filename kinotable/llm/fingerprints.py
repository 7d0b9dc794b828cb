"""Document fingerprints: bottom-k sketches of byte-shingle hashes.

A sketch holds the k smallest distinct hashes of a text's shingles (``WIDTH``
consecutive bytes; a shorter text is one shingle, an empty text has none).
The sketch of a union is the k smallest of both sketches, so parts of a text
or of a group of texts merge exactly.  From sketches alone come estimates of
resemblance, containment and the number of distinct shingles.

Defined cases: a null text counts as empty and has the empty fingerprint; two
empty sketches resemble each other fully (1.0), an empty and a filled one not
at all (0.0).  Long texts are hashed piece by piece, so memory stays bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinotable.llm.hashing import CHUNK_BYTES, running_sum, span_hashes

#: Bytes in a shingle.
WIDTH = 12
#: Hashes in a sketch; the standard error of a resemblance is about 0.5 / sqrt(K).
K = 128
#: Documents in one range of ids that a task streams through, about; ranges at most, beyond which they become larger.
RANGE_ROWS, MOST_RANGES = 4096, 1 << 14

_LEAST = -(1 << 63)


def _smallest(h: np.ndarray, k: int) -> np.ndarray:
    take = 4 * k
    while take < len(h):
        low = np.unique(np.partition(h, take)[: take + 1])
        if len(low) > k:
            return low[:k]
        take *= 8
    return np.unique(h)[:k]


def sketch(text: bytes, k: int = K, width: int = WIDTH) -> np.ndarray:
    """The k smallest distinct shingle hashes of a text, ascending."""
    if not text:
        return np.zeros(0, np.uint64)
    out = None
    for at in range(0, max(1, len(text) - width + 1), CHUNK_BYTES):
        piece = np.frombuffer(text, np.uint8)[at : at + CHUNK_BYTES + width - 1]
        start = np.arange(max(1, len(piece) - width + 1))
        own = _smallest(span_hashes(running_sum(piece), start, start + min(width, len(piece))), k)
        out = own if out is None else merge(out, own, k)
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two shingle sets."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, union, assume_unique=True).sum() / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    union = distinct(merge(a, b, k), k)
    return float(min(1.0, resemblance(a, b, k) * union / max(distinct(a, k), 1.0)))


def encoded(a: np.ndarray) -> str:
    """The sketch as hexadecimal digits, 16 for each hash."""
    return a.astype(">u8").tobytes().hex()


def decoded(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def edited_text(text: str, following: str) -> str:
    """The text with its last third replaced by the start of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(df: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """df with ``fingerprint`` and ``n_shingles`` (estimated) added; no shuffle."""
    kind = "fingerprint string, n_shingles double"

    @F.pandas_udf(kind)
    def of(column):
        import pandas as pd

        made = [sketch(x or b"", k) for x in column]
        return pd.DataFrame({"fingerprint": [encoded(x) for x in made], "n_shingles": [distinct(x, k) for x in made]})

    got = of(F.col(text).cast("binary"))
    return df.withColumn("__of", got).select(*[F.col(f"`{c}`") for c in df.columns if c not in ("fingerprint", "n_shingles")], "__of.fingerprint", "__of.n_shingles")


def merged_fingerprints(df: DataFrame, key: str, k: int = K) -> DataFrame:
    """One fingerprint for each ``key`` from the ``fingerprint``s of its rows.

    Only the k smallest hashes of each task and key travel, so a key that
    holds most rows is no heavier than any other.  Columns: key, fingerprint.
    """
    at = F.expr("sequence(1, length(fingerprint), 16)")
    pieces = df.filter(F.length("fingerprint") > 0).select(F.col(key), F.explode(F.transform(at, lambda i: F.substring(F.col("fingerprint"), i, F.lit(16)))).alias("h"))
    near = pieces.withColumn("r", F.dense_rank().over(Window.partitionBy(key).orderBy("h"))).filter(F.col("r") <= k)
    full = near.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("h")), "").alias("fingerprint"))
    return df.select(key).distinct().join(full, key, "left").withColumn("fingerprint", F.coalesce("fingerprint", F.lit("")))


def _bucket(bounds: list[int], side: str = "left") -> Column:
    """Number of bounds below doc_id (side right: not above it), found by bisection; null counts as lowest."""
    held = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def of(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(held, ids.to_numpy(np.int64), side).astype(np.int32))

    return of(F.coalesce(F.col("doc_id"), F.lit(_LEAST)))  # a batch with nulls would come as floats


def _bounds(docs: DataFrame, parts: int, top: int | None) -> list[int]:
    """Ids of the table that end its ranges, all but the greatest.

    Quantiles are doubles, which hold no id above 2**53 exactly, so each is
    replaced by the greatest id at or below it.
    """
    if parts <= 1:
        return []
    cuts = docs.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)
    cuts = sorted({min(max(int(x), _LEAST), -_LEAST - 1) for x in cuts})
    ends = docs.groupBy(_bucket(cuts).alias("b")).agg(F.max("doc_id").alias("end")).collect()
    return sorted({r.end for r in ends} - {None, top})


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, in_edited double"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
    bucket, held, out = None, None, []

    def finish(doc, following):
        doc_id, text, own = doc
        edit = edited_text(text, following[1]).encode()
        theirs = sketch(edit)
        out.append((doc_id, len(text), hashlib.sha256(edit).hexdigest(), encoded(own), encoded(theirs), resemblance(own, theirs), resemblance(own, following[2]), distinct(own), containment(own, theirs)))

    def ended(doc):
        if doc is not None:
            raise RuntimeError(f"no document follows the last one of range {bucket}, doc_id {doc[0]}")

    for batch in batches:
        for b, copy, doc_id, raw in zip(*(batch.column(i) for i in range(4))):
            if b.as_py() != bucket:
                ended(held)
                bucket, held = b.as_py(), None
            raw = raw.as_py() or b""
            if copy.as_py() and held is None:
                continue  # equal ids at a bound: only the first follows
            doc = (doc_id.as_py(), raw.decode("utf-8", "replace"), sketch(raw))
            if held is not None:
                finish(held, doc)
            held = None if copy.as_py() else doc
            if len(out) >= 256:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
                out.clear()
    ended(held)
    if out:
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)


def edit_likeness(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each document's fingerprint beside those of its edit and of the next document.

    The next document is the one that follows in descending doc_id (null ids
    last, equal ids by text); after the last comes the first.  Whole ids are
    dealt out by range and streamed in order, and the first document of each
    range is sent to the range above as well, so one shuffle carries each text
    once and no task holds more than a batch.  The driver sees the bounds of
    the ranges, at most MOST_RANGES numbers however large the table is.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    n, top = docs.agg(F.count(F.lit(1)), F.max("doc_id")).first()
    parts = min(-(-n // range_rows), MOST_RANGES)
    bounds = _bounds(docs, parts, top)
    bucket, last = _bucket(bounds), F.col("doc_id").eqNullSafe(F.lit(top))
    copied = last | (_bucket(bounds) != _bucket(bounds, "right"))
    dealt = docs.withColumn("bucket", bucket).withColumn("copied", copied)
    copies = F.when(F.col("copied"), F.array(F.struct(F.col("bucket"), F.lit(0).alias("copy")), F.struct(F.when(last, F.lit(0)).otherwise(F.col("bucket") + 1).cast("int").alias("bucket"), F.lit(1).alias("copy"))))
    dealt = dealt.select("doc_id", "text", F.explode(F.coalesce(copies, F.array(F.struct(F.col("bucket"), F.lit(0).alias("copy"))))).alias("at"))
    dealt = dealt.select("at.bucket", "at.copy", "doc_id", "text").repartitionById(len(bounds) + 1, F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "copy", F.desc_nulls_last("doc_id"), "text").mapInArrow(_rows, SCHEMA)
