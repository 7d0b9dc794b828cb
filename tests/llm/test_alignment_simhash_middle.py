"""Operators 11 to 13 beside plain versions written apart from them."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from kinotable.llm import fill_in_middle as fim
from kinotable.llm import simhash, token_alignment

SCHEMA = "doc_id long, text string, bits long, form string, key long"
SF = "/root/testdata/sf0.001"


def table(spark, docs):
    return spark.createDataFrame([(d, t, 1, "x", 2) for d, t in docs], SCHEMA)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11


def plain_middle(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n, hexed = len(tokens), digest(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(hexed[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ODD = ["", None, "a", "é", "漢字 kanji 漢", "<P> holds a mark", "almost <P", "S>", "<M", "aaa" * 5000, "1\n2\t3", "x" + "é" * 3000 + "yz", "\x00\x7f", "🙂ab🙂"]


def test_middles_are_those_of_a_plain_cut(spark):
    rng = random.Random(1)
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (3, "é"), (3, "é")]
    docs += [(100 + i, "".join(rng.choice("ab zé漢<>PSM\n") for _ in range(rng.randrange(400)))) for i in range(300)]
    made = fim.fill_in_middle(table(spark, docs))
    got = made.select("*", fim.restored(made.output, made.form).alias("back")).collect()
    key = lambda x: (str(x[0]), x[-1])
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted((plain_middle(*d) for d in docs), key=key)
    assert sorted((str(r.doc_id), r.back) for r in got) == sorted((str(d), t or "") for d, t in docs)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(table(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize(("step", "piece"), [(1, 1), (3, 7), (256, 1 << 20)])
def test_every_cut_of_the_index(step, piece):
    for text in (*[x for x in ODD if x], "ab c1é漢字x" * 30):
        if len(text) > 4000:
            continue
        tokens, index = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S), fim.UnitIndex(text.encode(), step, piece)
        assert (index.n, index.n_points) == (len(tokens), len(text)) and len(index.units) == -(-len(tokens) // step)
        for k in range(len(tokens) + 1):
            before = "".join(tokens[:k])
            assert index.cut(k) == (len(before.encode()), len(before))


# 12


class Plain:
    def __init__(self):
        import sentencepiece

        self.a = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
        # the byte-level alphabet: printable bytes stand for themselves, others for characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def groups(self, text):
        if not text:
            return None
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        bytes_a = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        told = [self.b.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, told)]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return None
        out, i, j = [], 0, 0
        while i < len(a):
            i0, j0, x, y = i, j, len(bytes_a[i]), len(bytes_b[j])
            while x != y:
                if x < y:
                    i += 1
                    x += len(bytes_a[i])
                else:
                    j += 1
                    y += len(bytes_b[j])
            i, j = i + 1, j + 1
            out.append((a[i0:i], b[j0:j]))
        return out


def plain_aligned(docs):
    own, held, count = Plain(), [], Counter()
    for doc_id, text in docs:
        groups = own.groups(text)
        links = Counter((x, y) for a, b in groups or [] for x in a for y in b)
        held.append((doc_id, groups, links))
        count.update(links.keys())
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for doc_id, groups, links in held:
        told = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups or [])
        sums = [sum(len(g[k]) for g in groups or []) for k in (0, 1)]
        n_best = sum(n for p, n in links.items() if count[p] == best[p[0]])
        out.append((doc_id, *sums, len(groups or []), sum(links.values()), n_best, sum(n * count[p] for p, n in links.items()), digest(told) if groups else ""))
    return sorted(out, key=str)


TOKEN_ODD = ["", None, " ", "a", "  two  spaces ", "a▁b", "<s> </s> <|endoftext|> <unk>", "naïve 漢字 🙂🙂", "\n\n tab\t x", "aaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "\x00 nul", "don't we'll", "x y", "=" * 900 + "-" * 77]


def test_alignment_is_that_of_a_plain_walk(spark, monkeypatch):
    rng = random.Random(2)
    docs = list(enumerate(TOKEN_ODD)) + [(3, "a"), (3, "a"), (None, "no id")]
    words = ["the", "alignment", "of", "tokens", "漢字", "naïve", "Über", "12345", "x=y;", "don't", "\n", "ﬁne"]
    docs += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(120)]
    docs += [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    want = plain_aligned(docs)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    read = lambda **x: sorted((tuple(r) for r in token_alignment.aligned(table(spark, docs), **x).select(columns).collect()), key=str)
    assert read() == want
    # many blocks, many keys for an id, and small pieces of work
    for name, value in (("BLOCK_LINKS", 300), ("AT_ONCE", 50), ("HELD", 40), ("WIDE", 3), ("COPIES", 1)):
        monkeypatch.setattr(token_alignment, name, value)
    assert read(shard=5) == want
    assert token_alignment.aligned(table(spark, docs).limit(0)).count() == 0


# 13


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashed = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashed) > len(hashed)) if words else 0


def plain_components(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprints_and_components_of_texts(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t", "ONE", "one", "Two  words", "a b c", "Ä B C d", "a b c a b c a b c", "x " * 50_000]
    for _ in range(40):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(300)] = f"e{rng.randrange(30)}"
        texts.append(" ".join(words))
    docs = list(enumerate(texts, 10)) + [(None, "one"), (5, "three new words"), (5, "three new words"), (None, "lonely text without id")]
    prints = [plain_print(t) for _, t in docs]
    roots = plain_components(prints, [d for d, _ in docs])
    got = simhash.near_copies(table(spark, docs)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(((d, f"{p:016x}", r) for (d, _), p, r in zip(docs, prints, roots)), key=key)
    assert len({r for r in roots}) < len({*prints})
    assert simhash.near_copies(table(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize(("crowd", "tile", "pairs"), [(4096, 2048, 1 << 21), (20, 7, 64), (3, 1, 1)])
def test_links_find_the_components_of_all_pairs(spark, monkeypatch, crowd, tile, pairs):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = random.Random(4)
    prints = {0, (1 << 64) - 1, 1 << 63, 0b111, 0b1111 << 40}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):  # chains, and crowds around one value
            prints.add(x)
            y = x
            for _ in range(rng.choice((1, 2, 3, 4, 5))):
                y ^= 1 << rng.randrange(64)
            prints.add(y)
            x = y if rng.random() < 0.3 else x
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "bits long"), crowd, tile).collect()
    at = {p: i for i, p in enumerate(signed)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in found:
        root[find(at[r.a])] = find(at[r.b])
    want = plain_components(prints, range(len(prints)))
    least = {}
    for i in range(len(prints)):
        least.setdefault(find(i), i)
    assert [least[find(i)] for i in range(len(prints))] == want
    assert 1 < len(set(want)) < len(prints)


def test_anchors_within_two_of_a_side_are_words_of_the_code():
    table = simhash.syndromes()
    place = lambda x: int(np.bitwise_xor.reduce([i + 1 for i in range(31) if x >> i & 1] or [0]))
    for s, deltas in enumerate(table):
        assert all(place(d) == s and d.bit_count() <= 2 for d in deltas)
        assert len(set(deltas)) == len(deltas) == (16 if s else 1)
