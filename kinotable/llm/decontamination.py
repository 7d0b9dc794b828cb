"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts become words (runs of digits, small letters and non-ASCII characters
after lower-casing A-Z).  Hashes of GRAM consecutive words are winnowed: of
each run of them that fills a window of WINDOW words the least is kept, so two
texts that share WINDOW words in a row share a kept hash.  Items shorter than
a window are one window of their own length, of which the whole hash is kept.

One pass splits every text once: it counts the words and keeps the hashes that
a bit array of the benchmark's hashes lets through.  What is left is joined
with the benchmark's hashes, and only in documents that this hits are whole
windows compared, word for word.  (A full bit array lets more hashes through
to the join, nothing else.)

Defined cases: a null or wordless text has no words, no hits and is clean;
repeated rows each get their result; items without words are not searched for;
items with a null item_id hit words like others but are in no list of ids; with
no items every document is clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinotable.llm.columns import constants, let, lowered
from kinotable.llm.saving import checkpointed

#: Words in a window and in a hashed gram.
WINDOW, GRAM = 13, 5
#: Most benchmark windows, or hit documents, that are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Least and most bits of the array that tells which hashes the benchmark may have.
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 22
#: A document is contaminated if this part of its words is hit.
PART = 20

#: Characters that part words, each by itself: the regex engine then looks them up in one table of bits.
_APART = "".join(f"\\x{i:02X}" for i in range(128) if not chr(i).isalnum())


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(lowered(F.coalesce(text.cast("string"), F.lit(""))), F.lit(f"[^{_APART}]+"), F.lit(0))


def _upto(n: Column) -> Column:
    """0, 1, ... n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _runs(h: Column, length: int) -> Column:
    """The hash of every ``length`` consecutive word hashes."""
    return F.transform(_upto(F.size(h) - (length - 1)), lambda i: F.xxhash64(*[h[i + k] for k in range(length)]))


def _least(x: Column, width: int, held: int = 1) -> Column:
    """The least of every ``width`` neighbours; x has those of ``held``, which doubles at each step."""
    if held == width:
        return x
    step = min(held, width - held)
    return let(x, lambda g: _least(F.transform(_upto(F.size(g) - step), lambda i: F.least(g[i], g[i + step])), width, held + step))


def _kept(h: Column, length: int, window: int, gram: int) -> Column:
    """For each window of ``length`` words the hash that is kept, from hashes of words."""
    if length < window or length <= gram:
        return _runs(h, length)
    return _least(_runs(h, gram), length - gram + 1)


def _hashes(own: Column) -> Column:
    return F.transform(own, lambda w: F.xxhash64(w))


def minima(own: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """For each window of words its least gram hash; empty for shorter texts."""
    return let(_hashes(own), lambda h: _kept(h, window, window, gram))


def _spans(own: Column, length: int) -> Column:
    """Every run of ``length`` words, joined by blanks (which no word has)."""
    return F.transform(_upto(F.size(own) - (length - 1)), lambda i: F.concat_ws(" ", F.slice(own, i + 1, length)))


def _sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _may_have(marks: DataFrame, n: int):
    """A test of hashes: false only for those that are not among the n ``marks`` (column h)."""
    bits = LEAST_BITS
    while bits < min(64 * n, MOST_BITS):
        bits *= 2
    at = F.pmod("h", F.lit(bits))
    rows = marks.select(F.shiftright(at, 6).alias("w"), (at % 64).alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, cast(b as int))")).alias("v")).collect()
    held = {r.w: r.v for r in rows}
    table = constants([held.get(w, 0) for w in range(bits // 64)])
    place = lambda h: F.pmod(h, F.lit(bits))
    return lambda h: F.getbit(table[F.shiftright(place(h), 6).cast("int")], (place(h) % 64).cast("int")) == 1


def _of(hits: Column, length: int) -> Column:
    """The hashes of the hits of one length."""
    return F.transform(F.filter(hits, lambda x: x["length"] == length), lambda x: x["h"])


def _places(kept: Column):
    """From hashes, the places at which ``kept`` has one of them."""
    return lambda hashes: F.filter(F.transform(kept, lambda h, i: F.when(F.array_contains(hashes, h), i)), lambda i: i.isNotNull())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("own")).filter(F.size("own") > 0)
    items = checkpointed(items.withColumn("length", F.least(F.size("own"), F.lit(window))))
    lengths = sorted(r.length for r in items.select("length").distinct().collect())
    kept = lambda own, n: let(_hashes(own), lambda h: _kept(h, n, window, gram))
    tests = {}
    if lengths:
        mine = {n: items.filter(F.col("length") == n).withColumn("length", F.lit(n)) for n in lengths}
        spans = [df.select("length", "item_id", F.explode(_spans(F.col("own"), n)).alias("span")) for n, df in mine.items()]
        marks = [df.select("length", F.explode(F.array_distinct(kept(F.col("own"), n))).alias("h")) for n, df in mine.items()]
        spans = checkpointed(reduce(DataFrame.union, spans).groupBy("length", "span").agg(F.collect_set("item_id").alias("items")))
        marks = checkpointed(reduce(DataFrame.union, marks).distinct())
        sizes = {r.length: r["n"] for r in marks.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
        tests = {n: _may_have(marks.filter(F.col("length") == n), sizes[n]) for n in lengths}
    named = lambda n: lambda x: F.struct(F.lit(n).alias("length"), x.alias("h"))
    met = lambda h: F.concat(*[F.transform(F.array_distinct(F.filter(_kept(h, n, window, gram), tests[n])), named(n)) for n in lengths])
    none = F.array().cast("array<struct<length:int,h:bigint>>")
    facts = lambda own: F.struct(F.size(own).cast("long").alias("n_words"), (let(_hashes(own), met) if lengths else none).alias("met"))
    plain = checkpointed(keyed.select("doc_id", "text_hash", let(words(F.col("text")), facts).alias("f")).select("doc_id", "text_hash", "f.*"))
    met_rows = plain.filter(F.size("met") > 0).select("doc_id", "text_hash", F.explode("met").alias("m")).select("doc_id", "text_hash", "m.*")
    found = plain.limit(0).select("doc_id", "text_hash", F.lit(0).alias("start"), F.lit(0).alias("end"), F.array(F.lit("")).alias("items"))
    if lengths:
        n_spans = spans.count()
        hits = met_rows.join(_sized(marks, sum(sizes.values())), ["length", "h"]).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("length", "h")).alias("hits"))
        hits = checkpointed(hits.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "hits"))
        near = keyed.join(_sized(hits, hits.count()), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")))
        near = near.select("doc_id", "text_hash", words(F.col("text")).alias("own"), "hits").dropDuplicates(["doc_id", "text_hash"])
        for length in lengths:
            hit = _of(F.col("hits"), length)
            runs = near.filter(F.size(hit) > 0).select("doc_id", "text_hash", "own", F.explode(let(hit, _places(kept(F.col("own"), length)))).alias("start"))
            runs = runs.select(F.lit(length).alias("length"), "doc_id", "text_hash", "start", F.concat_ws(" ", F.slice("own", F.col("start") + 1, length)).alias("span"))
            same = runs.join(_sized(spans, n_spans), ["length", "span"]).select("doc_id", "text_hash", "start", (F.col("start") + length).alias("end"), "items")
            found = found.unionByName(same)
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = found.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), reach)))
    hit = hit.groupBy("doc_id", "text_hash").agg(F.sum("fresh").cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    hit = hit.withColumnRenamed("doc_id", "hit_id").withColumnRenamed("text_hash", "hit_hash")
    out = plain.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(item_ids).cast("long").alias("n_items"), F.sha2(F.array_join(item_ids, ",").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (PART * n_hit >= F.col("n_words"))).alias("contaminated"), item_ids.alias("item_ids"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, with all its columns, without the contaminated documents."""
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    bad = checkpointed(bad)
    return docs.join(_sized(bad, bad.count()), docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["bad_hash"]), "left_anti")


ORACLE = """
with d as (select doc_id, coalesce(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) w from documents),
b as (select cast(item_id as varchar) item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark where item_id is not null),
bl as (select item_id, w, least(len(w), 13) l from b where len(w) > 0),
bw as (select distinct item_id, l, array_to_string(w[i:i + l - 1], ' ') s from (select item_id, w, l, unnest(range(1, len(w) - l + 2)) i from bl)),
ls as (select distinct l from bl),
dw as (select doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') s from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) i from d, ls where len(w) >= l)),
m as (select doc_id, i, dw.l, item_id from dw join bw on dw.s = bw.s and dw.l = bw.l),
h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + l)) p from m) group by doc_id),
t as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) s from m group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""
