import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinotable.llm import mixing

SCHEMA = "doc_id long, text string, source string, slot string"


def rows(spark, counts):
    data = [(i, f"t{i}", s, "own") for i, s in enumerate(itertools.chain.from_iterable([s] * n for s, n in counts.items()))]
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("parts", [[1, 1, 1], [5, 2, 1], [500, 300, 200, 24], [1] * 40 + [984]])
def test_a_period_keeps_every_share_within_a_block(parts):
    order, period, had = mixing.one_period(parts), sum(parts), Counter()
    for t, s in enumerate(order, 1):
        had[s] += 1
        assert all(abs(had[k] * period - c * t) < period for k, c in enumerate(parts))
    assert [had[k] for k in range(len(parts))] == parts


def test_parts_add_up():
    assert sum(mixing.whole_parts([0.5, 0.2, 0.3, 1e-9], 64)) == 64
    assert min(mixing.whole_parts([1e9, 1e-9], 64)) == 1


def test_every_row_once_and_close_to_the_weights(spark):
    docs, weights = rows(spark, {"a": 90, "b": 60, None: 7, "c": 33}), {"a": 5.0, "b": 2.0, "c": 1.0, None: 1.0}
    got = mixing.mixed_order(docs, weights, block_docs=2, period=16).collect()
    assert sorted(r.doc_id for r in got) == list(range(190))
    for phase, mine in itertools.groupby(sorted(got, key=lambda r: r.slot), key=lambda r: r.phase):
        slots = sorted({(r.slot, r.source) for r in mine}, key=lambda x: x[0])
        assert len({s for s, _ in slots}) == len(slots)  # one block in a slot
        live = sorted({s for _, s in slots}, key=lambda s: (s is None, str(s)))
        if phase == 0:
            parts = dict(zip(live, mixing.whole_parts([weights[s] for s in live], 16)))
            had = Counter()
            for t, (slot, s) in enumerate(slots, 1):
                assert slot == t - 1
                had[s] += 1
                assert all(abs(had[k] * 16 - parts[k] * t) < 16 for k in live)
    slots = {r.slot for r in got}
    assert slots == set(range(len(slots)))  # no gaps between phases


def test_whole_rows_stay_with_clashing_names(spark):
    docs = rows(spark, {"a": 20, "b": 3}).union(rows(spark, {"a": 20}))
    out = mixing.mixed(docs, block_docs=4)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_edges(spark):
    assert mixing.mixed_order(spark.createDataFrame([], SCHEMA)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None), (None, None, None, None), (3, None, "a", None)], SCHEMA)
    assert mixing.mixed_order(nulls).count() == 3
    with pytest.raises(ValueError, match="target weight"):
        mixing.mixed_order(rows(spark, {"a": 1, "b": 1}), {"a": 1.0})
    with pytest.raises(ValueError, match="sources"):
        mixing.mixed_order(rows(spark, {str(i): 1 for i in range(9)}), max_sources=8)
    assert mixing.mixed(rows(spark, {"a": 5}).withColumn("extra", F.lit(1))).count() == 5


@pytest.mark.parametrize(("weights", "block"), [([0.9, 0.1], 8000), ([0.5] + [0.5 / 499] * 499, 40), ([1 / 3, 1e-4, 0.3, 7.0], 3000)])
def test_shares_stay_within_a_block_of_the_targets(weights, block):
    exact, blocks = mixing.whole_weights(weights), [block * (1 + s % 3) for s in range(len(weights))]
    out, starts = mixing.schedule(blocks, weights)
    assert Counter(out) == dict(enumerate(blocks))
    left = blocks.copy()
    for a, b in itertools.pairwise([*starts, len(out)]):
        live, had = [s for s, n in enumerate(left) if n], Counter()
        total = sum(exact[s] for s in live)
        for t, s in enumerate(out[a:b], 1):
            had[s] += 1
            left[s] -= 1
            if len(live) < 9 or t % 97 == 0:
                assert all(abs(had[k] * total - exact[k] * t) < total for k in live)


def test_rows_keep_the_target_weights_over_many_slots(spark):
    got = mixing.mixed_order(rows(spark, {"a": 4500, "b": 2000}), {"a": 0.9, "b": 0.1}, block_docs=1).filter("phase = 0").orderBy("slot").collect()
    assert len(got) > 4000 and [r.slot for r in got] == list(range(len(got)))
    had = 0
    for t, r in enumerate(got, 1):
        had += r.source == "a"
        assert abs(had - 0.9 * t) < 1


def test_many_sources(spark):
    got = mixing.mixed_order(rows(spark, {f"s{i}": 1 + i % 3 for i in range(1200)}), block_docs=2).collect()
    assert len({r.doc_id for r in got}) == len(got) == 2400
    assert len({(r.slot, r.source) for r in got}) == len({r.slot for r in got}) == 1600


def test_a_schedule_goes_on_from_any_of_its_states():
    for blocks, weights, period in (([40, 7, 0, 90, 1], [3.0, 1.0, 2.0, 0.5, 1e-3], None), ([30, 30, 9], [5.0, 2.0, 1.0], 16), ([5] * 60, [1 + i / 7 for i in range(60)], None)):
        out, starts = mixing.schedule(blocks, weights, period)
        assert Counter(out) == Counter({s: n for s, n in enumerate(blocks) if n})
        for window, most in ((1, 1 << 20), (7, 1 << 20), (1, 16 * len(blocks) * 5), (1000, 1)):
            states = mixing.checkpoints(blocks, weights, period, window, most)
            assert len(states) <= max(2, most // (16 * len(blocks))) or most == 1 << 20
            got, begun = [], []
            for slot, slots, phase, t, left, had in states:
                assert slot == len(got)
                own = mixing.Schedule(memoryview(left).cast("q").tolist(), weights, period, memoryview(had).cast("q").tolist(), t, phase, slot)
                more, phases = own.run(slots)
                got += more
                begun += [s for s, _ in phases]
            assert got == list(out) and begun == starts


def test_windows_give_the_slots_of_the_schedule(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 4)
    states = mixing.checkpoints
    monkeypatch.setattr(mixing, "checkpoints", lambda *x: states(*x, window=5))
    counts, weights = {"a": 90, "b": 31, None: 7, "c": 1}, {"a": 5.0, "b": 2.0, "c": 1.0, None: 0.25}
    names = ["a", "b", "c", None]
    out, starts = mixing.schedule([-(-counts[n] // 2) for n in names], [weights[n] for n in names])
    got = {(r.slot, r.source, r.phase) for r in mixing.mixed_order(rows(spark, counts), weights, block_docs=2).collect()}
    assert got == {(t, names[s], sum(x <= t for x in starts) - 1) for t, s in enumerate(out)}
