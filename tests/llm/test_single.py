"""Models by held-out accuracy, tokens by a plain search, packing by an exact round trip, the pipeline by its parts."""

import glob
import itertools
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from kinotable.llm import packing, quality, queries, token_counts, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score double, y int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1.0, 1) for d, t in rows], SCHEMA)


@pytest.mark.parametrize(("query", "label", "parts", "part", "threshold", "least"), [("op3_toxicity", "toxic", 3, 1, 0.7, 0.85), ("op8_quality", "quality", 5, 0, 0.3, 0.95)])
def test_held_out_accuracy(spark, query, label, parts, part, threshold, least):
    labels = dict(duckdb.sql(f"select doc_id, {label} from '{SF}/labels.parquet'").fetchall())
    rows = queries.QUERIES[query](spark, SF).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part) and r.predicted == int(r.score >= threshold) for r in rows)
    told = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in told) / len(told) >= least


def test_models_on_edges(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "word " * 3), (3, "word " * 3), (None, "x" * 100_000)])
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    toxic, good = toxicity.fit(docs, none), quality.fit(docs, none)
    assert {r.score for r in toxicity.toxicity_scores(docs, toxic).collect()} == {0.0}
    assert {r.score for r in quality.quality_scores(docs, good).collect()} == {0.5}
    assert toxicity.without_toxic(docs, toxic).count() == 5
    assert toxicity.toxicity_scores(docs.limit(0), toxic).count() == quality.quality_scores(docs.limit(0), good).count() == 0


def test_expected_counts_are_those_of_the_full_chain():
    rng = np.random.default_rng(3)
    docs = [(6, [1, 2, 5], [[0], [1, 2], [0]], [True, False, True]), (4, [0], [[2]], [True]), (5, [], [], []), (5, [], [], []), (1, [], [], []), (7, [3, 6], [[1], [0, 2]], [False, True]), (1, [0], [[1]], [True]), (0, [], [], [])]
    chains, w, bias, turns = toxicity._Chains(docs, 3), rng.normal(size=3), -1.2, rng.normal(size=(2, 2))
    word, total, pairs = np.zeros(3), 0.0, np.zeros((2, 2))
    true_pairs = np.zeros((2, 2))
    for n, at, held, ys in docs:
        lift = np.full(n, bias)
        for i, fs in zip(at, held):
            lift[i] += w[fs].sum()
        states = np.array(list(itertools.product((0, 1), repeat=n)), int)
        p = np.exp(states @ lift + sum((turns[states[:, i], states[:, i + 1]] for i in range(n - 1)), np.zeros(len(states))))
        p /= p.sum()
        total += p @ states.sum(1)
        for i, fs in zip(at, held):
            word[fs] += p @ states[:, i]
        truth = [0] * n
        for i, y in zip(at, ys):
            truth[i] = int(y)
        for i in range(n - 1):
            np.add.at(pairs, (states[:, i], states[:, i + 1]), p)
            true_pairs[truth[i], truth[i + 1]] += 1
    got = chains.expected(w, bias, turns)
    assert np.allclose(np.bincount(chains.feature, got[0][chains.word], 3), word)
    assert np.isclose(got[1], total) and np.allclose(got[2], pairs)
    assert (chains.pairs == true_pairs).all() and chains.words == sum(d[0] for d in docs)


def test_toxic_words_count_wherever_they_stand(spark):
    rng = np.random.default_rng(4)
    plain = [f"{a}{b}" for a in ("bo", "ka", "lu", "mi", "ne") for b in ("ra", "to", "su", "vi", "zo")]
    filler = lambda n: " ".join(rng.choice(plain, n))
    mild = lambda n: " ".join(filler(20) + " hmmm" for _ in range(n))
    docs = [(i, f"{mild(13)} {filler(20)} vile {filler(9)}") for i in range(40)] + [(i, f"{filler(200)} {mild(2) if i % 8 == 0 else ''}") for i in range(40, 200)]
    labels = spark.createDataFrame([(i, int(i < 40)) for i, _ in docs], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, docs), labels)
    assert model.weights["vile"] > 0 and model.weights["vile"] > model.weights["hmmm"]
    new = frame(spark, [(1, f"{mild(13)} {filler(20)} vile {filler(9)}"), (2, filler(300)), (3, f"{filler(200)} {mild(2)}")])
    scores = {r.doc_id: (r.score, r.spans) for r in toxicity.toxicity_scores(new, model).collect()}
    assert scores[1][0] >= toxicity.THRESHOLD > max(scores[2][0], scores[3][0])
    assert len(scores[1][1]) == 1


def plain_best(text, pieces):
    known, low = dict(pieces), min(s for _, s in pieces) - 10.0
    best = [(0.0, 0)] + [(-1e18, 0)] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            if piece in known and best[start][0] + known[piece] > best[end][0]:
                best[end] = (best[start][0] + known[piece], best[start][1] + 1)
        if text[end - 1] not in known and best[end - 1][0] + low > best[end][0]:
            best[end] = (best[end - 1][0] + low, best[end - 1][1] + len(text[end - 1].encode()))
    return best[-1]


def test_token_counts_agree_with_a_plain_search(spark):
    pieces = [("▁", -5.0), ("▁a", -3.0), ("a", -4.0), ("b", -4.0), ("ab", -8.0), ("ba", -7.0), ("▁ab", -7.0), ("aab", -9.0)]
    own, rng = token_counts.Unigram(pieces), np.random.default_rng(1)
    for _ in range(300):
        text = "".join(rng.choice(list("ab é"), rng.integers(1, 12)))
        assert own.count(text) == pytest.approx(plain_best("▁" + text.replace(" ", "▁"), pieces))
    out = token_counts.token_counts(frame(spark, [(1, None), (2, ""), (3, "hello world"), (3, "hello world")])).collect()
    assert {r.doc_id: r.n_tokens > 0 for r in out} == {1: False, 2: False, 3: True}


def test_packing_gives_all_ids_back(spark):
    rng = np.random.default_rng(2)
    docs = [(i, "word " * int(rng.integers(0, 900))) for i in range(40)] + [(90, None), (91, ""), (92, "long text " * 5000)]
    encode, got = packing.tokenizer(packing.VOCABULARY), {}
    rows = packing.packed_rows(frame(spark, docs), row_tokens=256, group_tokens=3000).collect()
    for r in rows:
        ids, ends = np.frombuffer(r.ids, "<u2"), list(r.cu_seqlens)
        assert len(ids) == 256 and ends[0] == 0 and ends[-1] == r.n_tokens and list(r.position_resets) == ends[:-1]
        for d, at, a, b in zip(r.doc_ids, r.doc_starts, ends, ends[1:]):
            got.setdefault(d, []).append((at, ids[a:b]))
    for d, text in docs:
        whole = np.concatenate([x for _, x in sorted(got[d], key=lambda p: p[0])])
        assert whole.tolist() == [*encode(text or "").tolist(), packing.END_ID]
    assert packing.packed_rows(frame(spark, docs).limit(0)).count() == 0


def test_best_fit_decreasing_fills_the_fullest_row():
    rows = packing.best_fit_decreasing(np.array([6, 5, 4, 3, 2]), 10)
    assert rows == [[0, 2], [1, 3, 4]]


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs, n = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns, first = docs.columns, {r.doc_id for r in docs.collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        assert glob.glob(str(tmp_path / str(i) / "*.parquet"))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
            ids = [r.doc_id for r in docs.collect()]
            assert len(ids) == len(set(ids)) and set(ids) <= first
            n.append(len(ids))
    assert n[0] >= n[1] >= n[2] == n[3] > 0
    assert {d for r in docs.collect() for d in r.doc_ids} == set(ids)
