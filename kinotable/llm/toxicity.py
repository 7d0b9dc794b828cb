"""Toxicity: a linear-chain conditional random field that tags toxic words.

Labels say which documents are toxic; words get theirs from these: among the
words and word beginnings that are significantly commoner in toxic documents,
greedy covers, one after the other, pick those that explain the toxic
documents, and the words of toxic documents that carry one are the toxic tokens.  A two-state chain model
(transitions, a bias, one weight for each significant word or beginning) is
fitted to all words of the labelled documents.  Scoring finds the words that carry a feature with an
Aho-Corasick automaton, runs forward and backward over them (the featureless
words between two of them are one closed-form matrix power, so the marginals
are those of the full chain; fitting does the same), and joins the marginals to a document score:
the chance that none is toxic, calibrated on the labelled documents.

Fitting uses at most ``sample_docs`` labelled documents, picked by a hash of
doc_id (of rows that agree in doc_id, the one whose text has the least hash);
everything else covers all rows and whole texts.

Defined cases: null and empty texts score like a text without toxic words;
repeated rows are scored each; with no toxic or no clean labelled document
every score is 0; labels that are null are not used.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinotable.llm.saving import checkpointed, dropped

#: Most labelled documents that a fit reads, and most features that it keeps.
SAMPLE_DOCS, MAX_FEATURES = 12_000, 4000
#: Lengths of word beginnings; chance of one false feature that a fit accepts.
BEGINNINGS, FALSE_FEATURE = (4, 5, 6, 7, 8), 0.05
#: Share of a feature's toxic documents that chance may explain for it to mark toxic words beside others.
CHANCE = 0.05
#: A document is toxic from this score on.
THRESHOLD = 0.7
#: Steps and regularisation of the fit.
STEPS, RIDGE = 200, 0.02

WORD = re.compile(r"[^\W\d_]+")


def lower(text: str) -> str:
    """Small letters, one for each character, so offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def features(word: str) -> list[str]:
    """The word itself and its beginnings (marked by ^)."""
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Model:
    """Weights of the chain; log potentials of state 1 against state 0."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    turns: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    fitted: bool = False
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def evidence(marginals: np.ndarray) -> float:
        """Log of 1 / the chance that none of the words is toxic, damped."""
        return math.log1p(min(40.0, float(-np.log1p(-np.minimum(marginals, 1 - 1e-12)).sum())) * 20)

    def plain(self) -> np.ndarray:
        """One featureless step: previous state by state."""
        return np.exp(np.array(self.turns)) * np.array([1.0, math.exp(self.bias)])

    def marginals(self, at: list[int], score: list[float], n: int) -> np.ndarray:
        """P(toxic) of the words numbered ``at`` (feature scores ``score``) in a chain of n words."""
        step = self.plain()
        values, left = np.linalg.eig(step)
        order = np.argsort(-values)
        values, left = values[order], left[:, order]
        right = np.linalg.inv(left)

        def power(k: int) -> np.ndarray:
            return (left * np.array([1.0, (values[1] / values[0]) ** k])) @ right

        lift = np.array([[1.0, math.exp(min(s, 60.0))] for s in score])
        start = np.array([1.0, math.exp(self.bias)])
        ahead, before = [], -1
        for k, i in enumerate(at):
            a = (start if i == 0 else start @ power(i)) if before < 0 else ahead[-1] @ power(i - before)
            a = a * lift[k]
            ahead.append(a / a.sum())
            before = i
        back, out = np.ones(2) if at[-1] == n - 1 else power(n - 1 - at[-1]) @ np.ones(2), []
        for k in range(len(at) - 1, -1, -1):
            both = ahead[k] * back
            out.append(both[1] / both.sum())
            if k:
                back = power(at[k] - at[k - 1]) @ (lift[k] * back)
                back = back / back.sum()
        return np.array(out[::-1])


def _tail(df1: int, df0: int, share: float) -> float:
    """Log chance of df1 or more toxic documents out of df0 + df1."""
    n = df0 + df1
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(df1, min(n, df1 + 60) + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def _cover(held: list[set[int]], by_chance: np.ndarray, strength: np.ndarray) -> set[int]:
    """Features that explain the toxic documents, the one that explains most first.

    ``by_chance``: toxic documents that a feature would be in if it said nothing.
    """
    rows = defaultdict(set)
    for i, fs in enumerate(held):
        for f in fs:
            rows[f].add(i)
    counts = {f: len(r) for f, r in rows.items()}
    chosen: set[int] = set()
    while counts:
        best = max(counts, key=lambda f: (counts[f] - 3 * by_chance[f], -strength[f], -f))
        if counts[best] - 3 * by_chance[best] < 1:
            break
        chosen.add(best)
        for i in list(rows[best]):
            for f in held[i]:
                rows[f].discard(i)
                counts[f] = len(rows[f])
        counts = {f: c for f, c in counts.items() if c}
    return chosen


def _covers(held: list[set[int]], by_chance: np.ndarray, strength: np.ndarray) -> set[int]:
    """Features of one cover after the other, each without those of the covers before it, until none explains anything.

    A single cover would leave out a toxic word whose documents others explain, and so teach that it is clean.
    After the first cover only features count of which chance explains a share of CHANCE or less.
    """
    counts = Counter(f for fs in held for f in fs)
    clear = {f for f, n in counts.items() if by_chance[f] <= CHANCE * n}
    chosen = _cover(held, by_chance, strength)
    while more := _cover([(fs & clear) - chosen for fs in held], by_chance, strength):
        chosen |= more
    return chosen


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a ridge logistic regression, by Newton steps."""
    z, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        curve = (z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
        beta = beta + np.linalg.solve(curve, z.T @ (y - p) - 0.01 * beta)
    return float(beta[0]), float(beta[1])


class _Chains:
    """Whole documents as chains; each stretch of featureless words is one matrix power.

    docs: (number of words, places of the words with features, the features of
    each, whether each is toxic); other words are not toxic.  Words with features
    stand by their number in the document, then by document, longest first, so
    that the k-th words of all documents are one slice.
    """

    def __init__(self, docs: list[tuple[int, list[int], list[list[int]], list[bool]]], n_features: int):
        self.n_features, self.n_docs = n_features, len(docs)
        bare = Counter(n for n, at, _, _ in docs if n and not at)
        self.bare, self.times = np.array(list(bare), int), np.array(list(bare.values()), float)
        docs = sorted((d for d in docs if d[1]), key=lambda d: -len(d[1]))
        size = np.array([len(d[1]) for d in docs], int)
        self.active = [int(c) for c in np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")]
        self.edge = np.concatenate(([0], np.cumsum(self.active))).astype(int)
        spot = np.concatenate([self.edge[: len(d[1])] + i for i, d in enumerate(docs)]) if docs else np.zeros(0, int)
        self.gap, self.truth = np.zeros(len(spot), int), np.zeros(len(spot))
        self.gap[spot] = [b - a for _, at, _, _ in docs for a, b in zip([0, *at], at)]
        self.truth[spot] = [y for d in docs for y in d[3]]
        self.tail = np.array([d[0] - 1 - d[1][-1] for d in docs], int)
        self.last = self.edge[size - 1] + np.arange(len(docs)) if docs else spot
        self.word = np.repeat(spot, [len(fs) for d in docs for fs in d[2]])
        self.feature = np.array([f for d in docs for fs in d[2] for f in fs], int)
        self.words = sum(d[0] for d in docs) + int(self.bare @ self.times)
        pairs = np.zeros((2, 2))
        for n, at, _, ys in docs:
            toxic = {i for i, y in zip(at, ys) if y}
            both = sum(i - 1 in toxic for i in toxic)
            pairs[1, 1] += both
            pairs[0, 1] += len(toxic) - both - (0 in toxic)
            pairs[1, 0] += len(toxic) - both - (n - 1 in toxic)
        pairs[0, 0] = self.words - len(docs) - self.times.sum() - pairs.sum()
        self.pairs = pairs

    def expected(self, w: np.ndarray, bias: float, turns: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """P(toxic) of the words with features, expected toxic words, and expected pairs of states."""
        start = np.array([1.0, math.exp(bias)])
        step = np.exp(turns) * start
        values, left = np.linalg.eig(step)
        order = np.argsort(-values)
        values, left = values[order], left[:, order]
        right, r = np.linalg.inv(left), values[1] / values[0]
        main, rest = np.outer(left[:, 0], right[0]), np.outer(left[:, 1], right[1])
        n, edge = len(self.gap), self.edge
        lift = np.exp(np.clip(np.bincount(self.word, w[self.feature], n), -40, 40))
        fade = r ** self.gap.astype(float)
        ahead, back = np.empty((n, 2)), np.empty((n, 2))
        a = np.tile(start, (len(self.tail), 1))
        for k, c in enumerate(self.active):
            on = slice(edge[k], edge[k + 1])
            a = a[:c] @ main + fade[on, None] * (a[:c] @ rest)
            a[:, 1] *= lift[on]
            a /= a.sum(1, keepdims=True)
            ahead[on] = a
        b = main.sum(1) + (r ** self.tail.astype(float))[:, None] * rest.sum(1)
        for k in range(len(self.active) - 1, -1, -1):
            on, c = slice(edge[k], edge[k + 1]), self.active[k]
            back[on] = b[:c]
            x = b[:c].copy()
            x[:, 1] *= lift[on]
            x = x @ main.T + fade[on, None] * (x @ rest.T)
            b[:c] = x / x.sum(1, keepdims=True)
        both = ahead * back
        marginal = both[:, 1] / both.sum(1)
        back[:, 1] *= lift
        firsts = len(self.tail)
        before = np.concatenate([np.tile(start, (firsts, 1)), ahead[np.arange(firsts, n) - np.repeat(self.active[:-1], self.active[1:])], ahead[self.last], np.tile(start, (len(self.bare), 1))])
        after = np.concatenate([back, np.ones((firsts + len(self.bare), 2))])
        length = np.concatenate([self.gap, self.tail, self.bare - 1]).astype(float)
        times = np.concatenate([np.ones(n + firsts), self.times])
        u, v, fade = before @ left, after @ right.T, r**length
        whole = u[:, 0] * v[:, 0] + fade * u[:, 1] * v[:, 1]
        part = times / whole
        once = part * (1 - fade) / (1 - r)
        shared = np.array([[u[:, 0] * v[:, 0] @ (part * length), u[:, 0] * v[:, 1] @ once], [u[:, 1] * v[:, 0] @ once, u[:, 1] * v[:, 1] @ (part * length * r ** np.maximum(length - 1, 0))]])
        pairs = step / values[0] * (right.T @ shared @ left.T)
        begin = np.append(np.arange(firsts), np.arange(n + firsts, len(whole)))
        toxic_first = start[1] * (left[1, 0] * v[begin, 0] + fade[begin] * left[1, 1] * v[begin, 1]) @ part[begin]
        return marginal, float(toxic_first + pairs[:, 1].sum()), pairs

    def fitted(self) -> tuple[np.ndarray, float, np.ndarray]:
        """Weights, bias and turns by full-batch adaptive gradient ascent on the likelihood."""
        n, toxic = self.n_docs, self.truth.sum()
        w, bias, turns = np.zeros(self.n_features), math.log((toxic + 1) / (self.words - toxic + 1)), np.zeros((2, 2))
        gained = [np.full(self.n_features, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
        for _ in range(STEPS):
            marginal, total, pairs = self.expected(w, bias, turns)
            off = self.truth - marginal
            grads = [(np.bincount(self.feature, off[self.word], self.n_features) - RIDGE * w) / n, (toxic - total - RIDGE * bias) / n, (self.pairs - pairs - RIDGE * turns) / n]
            gained = [g + d * d for g, d in zip(gained, grads)]
            w, bias, turns = (x + 0.5 * d / np.sqrt(g) for x, d, g in zip((w, bias, turns), grads, gained))
        return w, float(bias), turns


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of doc_id as text, modulo ``parts``, is ``part``; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def _text(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_docs: int = SAMPLE_DOCS, max_features: int = MAX_FEATURES) -> Model:
    """Fit to the documents that ``labels`` (doc_id, label) names; leave held-out rows out first."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")
    # one row for each id, so that the sample is bounded in rows; written once, as four passes read it
    rows = checkpointed(rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text")).select("y", "text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, y = [], batch.column(0).to_pylist()
            for raw in batch.column(1):
                found.append(sorted({f for w in set(WORD.findall(lower(_text(raw.as_py())))) for f in features(w)} | {""}))
            yield pa.record_batch([pa.array(y, pa.int32()), pa.array(found, pa.list_(pa.string()))], ["y", "f"])

    counts = rows.mapInArrow(split, "y int, f array<string>").select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("df1"), F.sum(1 - F.col("y")).alias("df0"))
    total = counts.filter("f = ''").first()
    if total is None or not total.df1 or not total.df0:
        return Model()
    share = total.df1 / (total.df1 + total.df0)
    often = counts.filter((F.col("f") != "") & (F.col("df1") >= 3) & (F.col("df1") / (F.col("df1") + F.col("df0")) > math.sqrt(share)))
    often = often.withColumn("lead", F.col("df1") * F.log(F.col("df1") / (F.col("df1") + F.col("df0")) / share)).orderBy(F.desc("lead"), "f").limit(max_features).collect()
    limit = math.log(FALSE_FEATURE / max(counts.count(), 1))
    kept = [r for r in often if _tail(r.df1, r.df0, share) <= limit] or [r for r in often if not r.df0][:50]
    if not kept:
        return Model()
    number = {r.f: i for i, r in enumerate(kept)}

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, n, at, held = batch.column(0).to_pylist(), [], [], []
            for raw in batch.column(1):
                tokens = WORD.findall(lower(_text(raw.as_py())))
                own = [(i, [number[f] for f in features(w) if f in number]) for i, w in enumerate(tokens)]
                own = [(i, fs) for i, fs in own if fs]
                n.append(len(tokens))
                at.append([i for i, _ in own])
                held.append([fs for _, fs in own])
            yield pa.record_batch([pa.array(y, pa.int32()), pa.array(n, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(held, pa.list_(pa.list_(pa.int32())))], ["y", "n", "at", "held"])

    got = rows.mapInArrow(active, "y int, n int, at array<int>, held array<array<int>>").collect()
    dropped(rows)
    got.sort(key=lambda r: (r.y, r.n, r.at, r.held))
    strength = np.array([_tail(r.df1, r.df0, share) for r in kept])
    cover = _covers([{f for fs in r.held for f in fs} for r in got if r.y], np.array([r.df0 * share / (1 - share) for r in kept]), strength)
    toxic = [[bool(r.y) and not cover.isdisjoint(fs) for fs in r.held] for r in got]
    w, bias, turns = _Chains([(r.n, r.at, r.held, ys) for r, ys in zip(got, toxic)], len(kept)).fitted()
    model = Model({r.f: float(w[i]) for i, r in enumerate(kept)}, bias, tuple(map(tuple, turns.tolist())), True)
    told = [(model.evidence(model.marginals(r.at, [float(w[fs].sum()) for fs in r.held], r.n)) if r.at else 0.0, r.y) for r in got]
    model.slope, model.shift = _calibrated(*np.array(told, float).T)
    return model


class Tagger:
    """Scores texts with a fitted model."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.automaton = model, None
        found: dict[str, list[tuple[bool, float]]] = defaultdict(list)
        for f, w in model.weights.items():
            found[f.removeprefix("^")].append((f.startswith("^"), w))
        if model.fitted and found:
            self.automaton = ahocorasick.Automaton()
            for f, xs in found.items():
                self.automaton.add_word(f, (len(f), xs))
            self.automaton.make_automaton()

    def tag(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, marginal) of each word that carries a feature."""
        if self.automaton is None:
            return []
        low = lower(text)
        scores: Counter[int] = Counter()
        letter = lambda c: c.isalnum() and not c.isdecimal()
        for end, (size, xs) in self.automaton.iter(low):
            start = end + 1 - size
            if start and letter(low[start - 1]):
                continue
            ends = end + 1 == len(low) or not letter(low[end + 1])
            for beginning, w in xs:
                if beginning and size in BEGINNINGS or ends and not beginning:
                    scores[start] += w
        if not scores:
            return []
        starts = sorted(scores)
        at, ends, last, n = [], [], 0, 0
        for m in WORD.finditer(low):  # only for texts with a hit
            if m.start() in scores:
                at.append(n)
                ends.append(m.end())
            n += 1
        return list(zip(starts, ends, self.model.marginals(at, [scores[s] for s in starts], n).tolist()))

    def score(self, spans: list[tuple[int, int, float]]) -> float:
        """Calibrated chance that the text is toxic; one without a tagged word has no evidence."""
        if not self.model.fitted:
            return 0.0
        x = self.model.slope * self.model.evidence(np.array([m for _, _, m in spans])) + self.model.shift
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, spans (character offsets and marginals of words at 0.5 or more); no shuffle."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for raw in batch.column(1):
                found = tagger.tag(_text(raw.as_py()))
                scores.append(tagger.score(found))
                spans.append([{"start": s, "end": e, "marginal": m} for s, e, m in found if m >= 0.5])
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(score, "doc_id long, score double, spans array<struct<start:int,end:int,marginal:double>>")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(model)
        for column in texts:
            yield pd.Series([tagger.score(tagger.tag(_text(x))) for x in column])

    return docs.filter(of(F.col("text").cast("binary")) < threshold)
