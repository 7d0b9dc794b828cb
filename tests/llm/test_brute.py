"""Brute-force versions of packing, quality, fingerprints and the tagger's marginals, and held-out recall."""

import itertools
import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from kinotable.llm import fingerprints, packing, quality, queries, toxicity


def plain_best_fit(lengths, room):
    rows = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rows if room - sum(r) >= n]
        if fits:
            min(fits, key=lambda r: room - sum(r)).append(n)
        else:
            rows.append([n])
    return rows


@pytest.mark.parametrize("room", [1, 10, 37, 256])
def test_best_fit_is_that_of_a_linear_search(room):
    rng = np.random.default_rng(room)
    for n in (0, 1, 5, 400):
        lengths = rng.integers(1, room + 1, n)
        got = packing.best_fit_decreasing(lengths, room)
        assert sorted(i for r in got for i in r) == list(range(n))
        # rows of equal room may be taken in any order, which doesn't change what rows hold
        assert Counter(tuple(sorted(lengths[r].tolist())) for r in map(np.array, got)).total() == len(plain_best_fit(lengths.tolist(), room))
        assert sorted(int(lengths[r].sum()) for r in map(np.array, got)) == sorted(sum(r) for r in plain_best_fit(lengths.tolist(), room))


def test_quality_scores_are_those_of_dense_densities(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefg"), rng.integers(1, 9)))
    good = [(i, " ".join(word() for _ in range(rng.integers(20, 80))) + ".") for i in range(60)]
    bad = [(100 + i, "!! ".join(word().upper() for _ in range(rng.integers(5, 30))) + " 99 ##") for i in range(50)]
    docs = spark.createDataFrame([*good, *bad, (900, ""), (901, None), (902, "x" * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad], "doc_id long, quality int")
    x = {r.doc_id: np.array(r.x) for r in quality.document_statistics(docs).collect()}
    y = {i: int(i < 100) for i, _ in good + bad}
    own = {c: np.array([x[i] for i in y if y[i] == c]) for c in (0, 1)}
    cov = {c: np.cov(v.T, bias=True) for c, v in own.items()}
    shared = (len(own[0]) * cov[0] + len(own[1]) * cov[1]) / len(y)

    def density(v, c):
        s = (1 - quality.POOLED) * cov[c] + quality.POOLED * shared
        s = (1 - quality.DIAGONAL) * s + quality.DIAGONAL * np.diag(np.diag(s)) + 1e-4 * np.eye(len(s))
        off = v - own[c].mean(0)
        return math.log(len(own[c]) / len(y)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * off @ np.linalg.inv(s) @ off

    got = {r.doc_id: r.score for r in quality.quality_scores(docs, quality.fit(docs, labels)).collect()}
    for i, v in x.items():
        assert got[i] == pytest.approx(1 / (1 + math.exp(-np.clip((density(v, 1) - density(v, 0)) / len(v), -500, 500))), abs=1e-9)
    one_class = quality.fit(docs, labels.filter("quality = 1"))
    assert {r.score for r in quality.quality_scores(docs, one_class).collect()} == {0.5}


def test_sketches_are_the_least_hashes_of_plain_sets():
    rng = np.random.default_rng(2)
    hashed = {}

    def plain(text, k):
        shingles = {text[i : i + 12] for i in range(max(1, len(text) - 11))} if text else set()
        for s in shingles:
            if s not in hashed:
                hashed[s] = int(fingerprints.sketch(s)[0])  # of one shingle alone
        return sorted({hashed[s] for s in shingles})[:k]

    texts = [b"", b"short", b"exactly12byt", *(rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in (13, 100, 900, 3000))]
    for k in (1, 16, 128):
        for a, b in itertools.product(texts, texts):
            x, y = plain(a, k), plain(b, k)
            assert fingerprints.sketch(a, k).tolist() == x
            union = sorted({*x, *y})[:k]
            want = len({*x} & {*y} & {*union}) / len(union) if x and y else float(not x and not y)
            assert fingerprints.resemblance(fingerprints.sketch(a, k), fingerprints.sketch(b, k), k) == pytest.approx(want)


def test_marginals_are_those_of_all_state_paths():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7):
        for at in ([0], [n - 1], sorted(rng.choice(n, min(n, 3), replace=False).tolist()), list(range(n))):
            at = sorted(set(at))
            model = toxicity.Model({}, float(rng.normal()), tuple(map(tuple, rng.normal(size=(2, 2)))), True)
            score = rng.normal(size=len(at)).tolist()
            states = np.array(list(itertools.product((0, 1), repeat=n)), int)
            lift = np.full(n, model.bias)
            lift[at] += score
            turns = np.array(model.turns)
            p = np.exp(states @ lift + sum((turns[states[:, i], states[:, i + 1]] for i in range(n - 1)), np.zeros(len(states))))
            assert np.allclose(model.marginals(at, score, n), (p / p.sum()) @ states[:, at])


def test_the_tagger_finds_whole_words_and_beginnings():
    model = toxicity.Model({"vile": 3.0, "^scum": 2.0, "ab": 1.0}, -2.0, ((0.1, -0.3), (-0.2, 0.4)), True)
    text = "Vile words, scummy SCUM; ab abc viler xscum évile"
    words = [m.group() for m in toxicity.WORD.finditer(text.lower())]
    carry = {i: s for i, w in enumerate(words) if (s := 3.0 * (w == "vile") + 2.0 * w.startswith("scum") + 1.0 * (w == "ab"))}
    want = model.marginals(list(carry), list(carry.values()), len(words))
    got = toxicity.Tagger(model).tag(text)
    assert [text[a:b].lower() for a, b, _ in got] == [words[i] for i in carry] == ["vile", "scummy", "scum", "ab"]
    assert np.allclose([m for _, _, m in got], want)


@pytest.mark.parametrize(("sf", "recall"), [("sf0.01", 0.75), ("sf0.1", 0.9)])
def test_held_out_toxic_documents_are_found(spark, sf, recall):
    folder = f"/root/testdata/{sf}"
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{folder}/labels.parquet'").fetchall())
    told = Counter((labels[r.doc_id], r.predicted) for r in queries.op3_toxicity(spark, folder).collect() if r.held_out and r.doc_id in labels)
    assert told[1, 1] >= recall * (told[1, 1] + told[1, 0])
    assert told[1, 1] >= 0.9 * (told[1, 1] + told[0, 1])
