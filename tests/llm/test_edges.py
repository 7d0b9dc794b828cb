"""Empty tables, nulls, repeated rows and long texts for operators whose other tests don't have them."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinotable.llm import jaccard_join, line_dedup, token_counts
from kinotable.llm.saving import checkpointed, dropped

SCHEMA = "doc_id long, text string, nid long, n long, gone string"


def table(spark, docs):
    return spark.createDataFrame([(d, t, 7, 8, "x") for d, t in docs], SCHEMA)


def test_lines_of_repeated_and_nameless_rows(spark):
    line, other, near = "one two three four five six seven eight nine ten", "quite another line of some words", "one two three four five six seven eight nine"
    docs = [(1, line), (1, line), (1, f"{other}\n{line}"), (2, near), (None, other), (None, None), (3, "")]
    out = line_dedup.line_report(table(spark, docs)).collect()
    assert len(out) == len(docs)
    got = [(r.doc_id, r.n_lines, list(r.removed_lines)) for r in out]
    assert (2, 1, [0]) in got and (None, 1, [0]) in got and (None, 0, []) in got and (3, 1, []) in got
    # of the rows with doc_id 1 the text with the lesser hash is earlier; equal rows are one document
    assert sorted(x[1:] for x in got if x[0] == 1) in ([(1, []), (1, []), (2, [1])], [(1, [0]), (1, [0]), (2, [])])
    assert line_dedup.line_report(table(spark, docs).limit(0)).count() == 0
    kept = line_dedup.without_near_lines(table(spark, docs))
    assert kept.columns == [x.split()[0] for x in SCHEMA.split(", ")] and kept.count() == len(docs)


@pytest.mark.parametrize("short", [80, 37])
def test_crowds_of_near_lines(spark, monkeypatch, short):
    monkeypatch.setattr(line_dedup, "HOT", 4)
    monkeypatch.setattr(line_dedup, "SHORT", short)  # sets of 34 to 40 words are on both sides of 37
    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice((1, 3, 6))):
            words[rng.randrange(40)] = f"e{rng.randrange(30)}"
        docs.append((i, (" ", "  ", "\t")[i % 3].join(words)))
    sets, want = [set(t.split()) for _, t in docs], []
    for i, s in enumerate(sets):
        want.append((i, [0] if any(100 * len(s & k) >= 80 * len(s | k) for k in sets[:i]) else []))
    got = sorted((r.doc_id, list(r.removed_lines)) for r in line_dedup.line_report(table(spark, docs)).collect())
    assert got == want


def test_lines_in_and_outside_ascii_share_words(spark):
    lines = ["A+B 100% c,d E% %41 +x f~g h*i J", "a+b 100% C,D e% %41 +X f~g H*i j é", "a+b 100% c,d e% %41\x0b+x f~g h*i j É", "a b 100 c d e 41 x f g h i j é"]
    lines += ["É é Ü ü one two three four five", "é É ü Ü\x85 ONE two three\tfour five", "É Ü one two three four five six", "%c3%a9 %c3%89 ü Ü one two three four", "é ü one two three four five seven"]
    docs = [(i, line) for i, line in enumerate(lines)]
    low = {c: c + 32 for c in range(65, 91)}
    sets = [set(re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))) for _, t in docs]
    want = [(i, [0] if any(100 * len(s & k) >= 80 * len(s | k) for k in sets[:i]) else []) for i, s in enumerate(sets)]
    got = sorted((r.doc_id, list(r.removed_lines)) for r in line_dedup.line_report(table(spark, docs)).collect())
    assert got == want and 0 < sum(len(x) for _, x in want) < len(lines) - 2

def test_rare_words_are_told_from_common_ones(spark):
    rare, common = [f"r{i}" for i in range(20_000)], [f"c{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(rare)), (2, "\n".join([" ".join(common)] * 50))], "doc_id long, text string")
    ranks = line_dedup._ranks(docs)
    words = spark.createDataFrame([(w,) for w in rare + common], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    place = {r.w: ranks[r.h & (line_dedup.COUNTERS - 1)] for r in words}
    first = min(place[w] for w in common)
    assert sum(place[w] >= first for w in rare) < 40  # rare words that share a common word's counter


def test_components_of_nameless_rows_and_empty_tables(spark):
    text = " ".join("abcdefghijklmnop")
    docs = [(1, text), (None, text), (2, text + " q"), (3, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(table(spark, docs)).collect()), key=str)
    assert got == sorted([(1, 12, 1), (2, 13, 1), (3, 0, 3), (None, 12, None)], key=str)
    assert jaccard_join.jaccard_components(table(spark, docs).limit(0)).count() == 0


def test_long_texts_have_as_many_tokens_as_their_parts(spark):
    docs = [(1, "hello world"), (2, " ".join(["hello world"] * 30_000))]
    n = {r.doc_id: r.n_tokens for r in token_counts.token_counts(table(spark, docs)).collect()}
    assert n[2] == 30_000 * n[1]
    assert token_counts.token_counts(table(spark, docs).limit(0)).count() == 0


def test_the_whole_pipeline_gives_rows_of_clean_documents(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = {d for r in rows.collect() for d in r.doc_ids}
    assert ids and rows.count() > 0
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages == ["toxicity", "near_copies", "decontamination", "mixing", "packing"]


def test_written_tables_can_be_dropped(spark):
    first = checkpointed(spark.range(10))
    second = checkpointed(first.filter("id > 4"), done=[first])
    assert second.count() == 5 and first.inputFiles()
    path = first.inputFiles()[0].removeprefix("file:")
    import os

    assert not os.path.exists(path.removeprefix("//"))
    dropped(second)
    dropped(spark.range(1))
