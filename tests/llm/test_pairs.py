"""Operators on pairs against brute force, with planted near copies and every defined edge case."""

import hashlib
import random
import re

from kinotable.llm import decontamination as dc
from kinotable.llm import jaccard_join as jj
from kinotable.llm import line_dedup as ld
from kinotable.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, nid long, component_id long, extra_id string, bad_id string"
LOW = {c: c + 32 for c in range(65, 91)}
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, n=90):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ü", "漢字"]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice((3, 12, 40, 90)))] for _ in range(n // 6)]
    docs = [(1000, ""), (1001, None), (1002, " \t\n"), (1003, "one"), (1004, "ONE"), (1005, "one")]
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((i * 7 % n, "".join(w + rng.choice("   \n") for w in words)))
    return docs


def table(spark, docs):
    return spark.createDataFrame([(d, t, 1, 2, "x", None) for d, t in docs], SCHEMA).repartition(3)


def components(docs, width, percent):
    sets = []
    for _, t in docs:
        w = BLANK.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y, key=lambda k: docs[k][0])] = min(x, y, key=lambda k: docs[k][0])
    return sorted((d, len(s), docs[find(i)][0]) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def test_jaccard_components(spark):
    for seed, width, percent, leaf in ((1, 3, 90, 4096), (2, 5, 80, 4), (3, 2, 60, 3)):
        docs = corpus(seed)
        got = jj.jaccard_components(table(spark, docs), width, percent, leaf).collect()
        assert sorted(map(tuple, got)) == components(docs, width, percent)


def test_long_sets_have_a_join_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(jj, "_long", lambda percent: 20)
    docs = corpus(4)
    assert sorted(map(tuple, jj.jaccard_components(table(spark, docs), 3, 80).collect())) == components(docs, 3, 80)


def test_one_of_each(spark):
    text, other = " ".join("abcdefghijklmnop"), "quite different words that stand here alone"
    docs = [(1, text), (1, text), (2, text + " q"), (3, other), (1, other), (4, ""), (4, None), (None, text), (5, "x y z"), (5, "x y z")]
    out = jj.one_of_each(table(spark, docs))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, text), (1, other), (4, ""), (4, None), (None, text), (5, "x y z")], key=str)
    assert out.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert jj.one_of_each(table(spark, docs).limit(0)).count() == 0


def repeats(docs):
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            s = b[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeated_bytes(spark):
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdé 漢") for _ in range(rng.choice((90, 130, 400)))) for _ in range(8)]
    docs = [(i, "".join(rng.choice((rng.choice(passages), "".join(rng.choice("xyz ") for _ in range(60)))) for _ in range(rng.randrange(6)))) for i in range(60)]
    docs += [(100, "ab" * 400), (101, None), (102, "z" * 99), (103, "z" * 100), (104, "z" * 101)]
    for ranges in (1, 5):
        got = sd.without_repeats(table(spark, docs), ranges).drop("kept", "removed").collect()
        assert sorted(map(tuple, got)) == repeats(docs)
    assert sd.without_repeats(table(spark, docs).limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    rng = random.Random(8)
    text, other, last = ("".join(rng.choice("abcdé 漢") for _ in range(300)) for _ in range(3))
    docs = [(1, text)] * 3 + [(2, other + text + "end"), (2, other + text + "end"), (3, text), (None, last), (None, last), (None, last + "x" * 30), (4, "same short"), (4, "same short")]
    one = {r[0]: r[1:] for r in repeats([(1, text), (2, other + text + "end"), (3, text), (4, "same short")])}
    for ranges, parts in ((1, 1), (5, 6)):
        got = sd.without_repeats(table(spark, docs).repartition(parts), ranges).drop("kept", "removed").collect()
        assert len(got) == len(docs)
        assert all(tuple(r)[1:] == one[r.doc_id] for r in got if r.doc_id is not None)
        nulls = sorted((r.n_bytes, r.n_removed) for r in got if r.doc_id is None)
        n = len(last.encode())
        # the earlier of the two texts by hash stays whole, in all its rows; the other loses what they share
        assert nulls in ([(n, 0), (n, 0), (n + 30, n)], [(n, n), (n, n), (n + 30, 0)])


def gone_lines(docs, percent=80):
    kept, out = [], {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        for i, line in enumerate(t.split("\n") if t is not None else []):
            s = frozenset(BLANK.findall(line.translate(LOW)))
            if not s:
                continue
            if any(100 * len(s & k) >= percent * len(s | k) for k in kept):
                out.setdefault(d, []).append(i)
            kept.append(s)
    return sorted((d, out.get(d, [])) for d, _ in docs)


def test_near_lines(spark):
    rng = random.Random(6)
    lines = [" ".join(rng.choice([f"w{i}" for i in range(40)]) for _ in range(rng.choice((1, 4, 9, 20)))) for _ in range(30)]
    docs = [(i, "\n".join(rng.choice(lines) + rng.choice(("", "", " extra", " w1 more")) for _ in range(5))) for i in range(40)] + [(90, ""), (91, None), (92, "\n\n")]
    got = sorted((r.doc_id, list(r.removed_lines)) for r in ld.line_report(table(spark, docs)).collect())
    assert got == gone_lines(docs)
    texts = {r.doc_id: r.text for r in ld.without_near_lines(table(spark, docs)).collect()}
    held, gone = dict(docs), dict(gone_lines(docs))
    assert texts == {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in held.items()}


def contaminated(docs, items):
    word, out = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), []
    split = lambda t: word.findall((t or "").translate(LOW))
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            v = split(text)
            n = min(13, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_contamination(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(50)] + ["é", "Zürich", "42"]
    passage = lambda n: ", ".join(rng.choice(words) for _ in range(n))
    items = [(i, passage(n)) for i, n in enumerate((40, 13, 14, 5, 1, 60))] + [(9, ""), (10, None)]
    docs = [(i, passage(rng.choice((10, 60, 400))) + " " + rng.choice([x for _, x in items if x] + [""]).upper() + " " + passage(20)) for i in range(40)] + [(90, None), (91, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(table(spark, docs), bench).drop("text_hash", "item_ids").collect()
    assert sorted(map(tuple, got)) == contaminated(docs, items)
    left = {r.doc_id for r in dc.without_contaminated(table(spark, docs), bench).collect()}
    assert left == {r[0] for r in contaminated(docs, items) if not r[5]}
    assert dc.contamination(table(spark, docs), bench.limit(0)).filter("contaminated").count() == 0


def test_items_without_an_id_hit_words(spark):
    passage, short, named = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("p", 20), ("s", 4), ("n", 15)))
    docs = [(1, f"before {passage} after"), (2, f"x {short} y"), (3, named), (4, "nothing of these")]
    bench = spark.createDataFrame([(None, passage), (None, short), (None, named), (7, named), (None, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.item_ids, r.contaminated) for r in dc.contamination(table(spark, docs), bench).collect()}
    assert got == {1: (20, [], True), 2: (4, [], True), 3: (15, ["7"], True), 4: (0, [], False)}
    assert [r.doc_id for r in dc.without_contaminated(table(spark, docs), bench).collect()] == [4]
