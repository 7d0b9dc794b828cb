import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinotable.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, n_chars long, fingerprint string"


def brute(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1].encode()))
    out = []
    for i, (doc_id, text) in enumerate(order):
        n = len(text) // 3
        edit = text[: len(text) - n] + order[(i + 1) % len(order)][1][:n]
        out.append((doc_id, len(text), hashlib.sha256(edit.encode()).hexdigest(), round(fp.resemblance(fp.sketch(text.encode()), fp.sketch(edit.encode())), 9), round(fp.resemblance(fp.sketch(text.encode()), fp.sketch(order[(i + 1) % len(order)][1].encode())), 9)))
    return sorted(out, key=str)


def got(spark, docs, rows):
    df = spark.createDataFrame([(d, t, None, "x") for d, t in docs], SCHEMA)
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.edit_likeness(df, rows).collect()), key=str)


def test_edits_follow_the_order_of_ids_over_many_ranges(spark):
    rng = np.random.default_rng(1)
    docs = [(int(i), "".join(rng.choice(list("abcdé 漢"), rng.integers(0, 60)))) for i in rng.permutation(400) * 3]
    for rows in (1, 7, 1000):
        assert got(spark, docs, rows) == brute(docs)


def test_single_empty_null_and_repeated_rows(spark):
    assert got(spark, [(1, "abcdef")], 10) == brute([(1, "abcdef")])
    docs = [(5, "a b c d e f"), (5, "a b c d e f"), (2, ""), (None, "some text"), (7, "xyz" * 50)]
    assert got(spark, docs, 2) == brute(docs)
    empty = spark.createDataFrame([], SCHEMA)
    assert fp.edit_likeness(empty).count() == 0
    null = spark.createDataFrame([(1, None, None, None), (2, "abc", None, None)], SCHEMA)
    assert {r.doc_id: r.n_chars for r in fp.edit_likeness(null).collect()} == {1: 0, 2: 3}


def test_ids_that_doubles_do_not_hold(spark):
    rng = np.random.default_rng(3)
    ids = [*(int(x) for x in rng.integers(-(2**63), 2**63 - 1, 120)), *(2**60 + i for i in range(40)), 2**63 - 1, -(2**63)]
    docs = [(i, f"text {k} " * (k % 5)) for k, i in enumerate(ids)]
    for rows in (3, 50):
        assert got(spark, docs, rows) == brute(docs)
        assert got(spark, [*docs, (None, "no id"), (ids[0], "twice"), (None, "")], rows) == brute([*docs, (None, "no id"), (ids[0], "twice"), (None, "")])


def test_a_range_without_its_copy_is_an_error():
    batch = pa.record_batch([pa.array([1, 2]), pa.array([0, 0]), pa.array([7, 9]), pa.array([b"a", b"b"])], ["bucket", "copy", "doc_id", "text"])
    with pytest.raises(RuntimeError, match="range 1"):
        list(fp._rows(iter([batch])))


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    a = rng.integers(97, 123, 30_000).astype(np.uint8).tobytes()
    b = a[:15_000] + rng.integers(97, 123, 15_000).astype(np.uint8).tobytes()
    x, y = fp.sketch(a, 512), fp.sketch(b, 512)
    assert abs(fp.resemblance(x, y, 512) - 1 / 3) < 0.1
    assert abs(fp.containment(x, y, 512) - 1 / 2) < 0.15
    assert abs(fp.distinct(x, 512) / 29_989 - 1) < 0.15
    halves = fp.merge(fp.sketch(a[:20_000], 512), fp.sketch(a[20_000 - 11 :], 512), 512)
    assert (halves == x).all()


def test_long_texts_are_hashed_piece_by_piece(monkeypatch):
    text = bytes(range(97, 123)) * 40 + b"tail"
    whole = fp.sketch(text)
    monkeypatch.setattr(fp, "CHUNK_BYTES", 64)
    assert (fp.sketch(text) == whole).all()


def test_merged_fingerprints_are_those_of_the_union(spark):
    df = spark.createDataFrame([("k", "abcdefghijklmnop" * 20), ("k", "0123456789" * 30), ("e", None)], "key string, text string")
    out = {r.key: r.fingerprint for r in fp.merged_fingerprints(fp.fingerprints(df), "key").collect()}
    assert out["k"] == fp.encoded(fp.merge(fp.sketch(b"abcdefghijklmnop" * 20), fp.sketch(b"0123456789" * 30)))
    assert out["e"] == ""
    assert fp.fingerprints(df.withColumn("fingerprint", F.lit(1))).columns.count("fingerprint") == 1


def test_ranges_grow_where_their_number_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(fp, "MOST_RANGES", 3)
    docs = [(i, f"text {i} " * (i % 5)) for i in range(200)]
    assert got(spark, docs, 7) == brute(docs)
    assert len(fp._bounds(spark.createDataFrame([(d, t, None, "x") for d, t in docs], SCHEMA), 3, 199)) == 2
