"""Line dedup by an exact set-similarity join, with DataFrame functions only.

A line is the set of its words (A-Z lowered, split at blanks).  A line is
removed if an earlier one has a Jaccard similarity of PERCENT or more with it;
earlier means a smaller doc_id (nulls last), then a smaller hash of the text,
then a smaller line number, then a smaller digest of the set; lines are judged
on the input.

* Lines with the same set become one, at its earliest place.
* Words are ordered from rare to common.  Of two similar sets of n <= m words
  the first n - ceil(2 t n / (1 + t)) + 1 and m - ceil(t m) + 1 share a word, so
  only these prefixes are joined.
* Pairs that share a prefix word pass the length filter, the positional filter
  (words left after the shared one) and a parity filter: each word turns one of
  64 bits over (of 128 in sets of more than SHORT words), so the bits in which
  two sets differ are no more than the words that only one of them has.  Then
  the whole sets are compared.
* First each set meets two leads of each of its STAR rarest words: the earliest
  set with the word and the one with the most copies.  Sets that this leaves in
  place meet about LEADS more of each prefix word that is hot (in more than HOT
  sets and a SHARE of all), and only sets that are left then meet all earlier
  sets.  So a crowd of near copies gives a few pairs for each member, not all.

Two passes split the texts into words: one counts them, one writes a narrow row
for each line, from which all else is joined; the words of a line are looked
up again only where its set is in a pair.

Defined cases: a null text has no lines, an empty one has one empty line;
lines without words are never removed; rows that agree in doc_id and text are
one document, so each of them gets what that document gets; lines may be of
any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinotable.llm.columns import constants
from kinotable.llm.saving import checkpointed

#: Least similarity in percent.
PERCENT = 80
#: Counters that rank words by rarity; fixed, and a power of two.
COUNTERS = 1 << 16
#: Rarest words of a set by which it meets the earliest set first.
STAR = 3
#: Least sets of a hot word, and one part in so many of all sets; about how many more leads it has.
HOT, SHARE, LEADS = 128, 3000, 48
#: Most sets, or documents, that are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 500_000

#: Words of the sets for which 64 parity bits tell enough; only larger ones have b1.
SHORT = 80

_PARITY = ["b0", "b1"]
#: Blanks as they stand in the form of ``_encoded``.
_BLANKS = "(?:\\+|%09|%0a|%0b|%0c|%0d)+"


def _encoded(text: Column) -> Column:
    """The text with A-Z as small letters, in URL form: all of it is ASCII, so Spark's lower does it byte by byte.

    Letters outside ASCII are lower-case hex before and after, and no two texts
    get one form but those that differ in A-Z alone.
    """
    return F.lower(F.url_encode(text))


def _parts(text: Column) -> Column:
    """The encoded words of a text, with empty ones between and around blanks; without blanks but spaces, no regex is needed."""
    whole = _encoded(text)
    return F.when(F.contains(whole, F.lit("%0")), F.split(whole, _BLANKS)).otherwise(F.split(whole, "\\+"))


def _words(text: Column) -> Column:
    """Hashes of the words of a text, and of the empty word where blanks meet or stand at an end."""
    return F.transform(_parts(text), lambda w: F.xxhash64(w))


def _set(line: Column) -> Column:
    """The distinct word hashes of a line."""
    return F.array_remove(F.array_distinct(_words(line)), F.xxhash64(F.lit("")))


def _plain(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).filter("text is not null")


def _ranks(docs: DataFrame) -> list[int]:
    """The rank of each counter, from the rarest on; each word counts as often as it stands in the texts."""
    whole = F.replace(_encoded(F.col("text")), F.lit("%0a"), F.lit("+"))
    each = _plain(docs).select(F.explode(F.split(whole, "\\+")).alias("w")).select(F.xxhash64("w").alias("h"))
    counted = each.groupBy(F.col("h").bitwiseAND(COUNTERS - 1).alias("i")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = {r.i: r.n for r in counted}
    rank = [0] * COUNTERS
    for k, i in enumerate(sorted(range(COUNTERS), key=lambda i: (total.get(i, 0), i))):
        rank[i] = k
    return rank


def _name(word: Column) -> Column:
    """31 bits by which prefix words are joined; words that share them only give more pairs to compare."""
    return word.bitwiseAND((1 << 31) - 1).cast("int")


def _parity(n: Column, own: Column) -> list[Column]:
    """b0 and b1 of a set of n words."""
    turned = lambda bits, x: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int")))
    parity = lambda words: F.aggregate(words, F.lit(0).cast("long"), turned)
    # the halves of a large set add up, as parities, to the 64 bits that it would have if it were short
    part = lambda k: parity(F.filter(own, lambda x: x.bitwiseAND(64) == 64 * k))
    return [F.when(n <= SHORT, parity(own)).otherwise(part(0)), F.when(n <= SHORT, F.lit(0).cast("long")).otherwise(part(1))]


def _lines(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_hash, line_no, n, k1, k2, parity, prefix (rarest first) of each line, written out; n is 0 without words.

    Each step uses columns of the one before more than once, so Spark keeps
    them apart and compiles what is not a lambda.
    """
    rank = constants([r << 47 for r in _ranks(docs)])
    place = ["doc_id", "text_hash", "line_no"]
    lines = _plain(docs).select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    hashed = lines.select(*place, _set(F.col("line")).alias("h"))
    # a word is its rank and 47 bits of its hash, so order is by rarity and equal words stay equal
    ranked = F.transform("h", lambda h: rank[h.bitwiseAND(COUNTERS - 1).cast("int")].bitwiseOR(F.shiftrightunsigned(h, 17)))
    sets = hashed.select(*place, F.size("h").alias("n"), F.sort_array(ranked).alias("own"))
    n, own = F.col("n"), F.col("own")
    keep = n - F.ceil(n * percent / F.lit(100)).cast("int") + 1
    facts = [F.xxhash64(own).alias("k1"), F.xxhash64(own, F.lit(1)).alias("k2"), *[x.alias(b) for x, b in zip(_parity(n, own), _PARITY)], F.transform(F.slice(own, 1, keep), _name).alias("prefix")]
    return checkpointed(sets.select(*place, "n", *facts))


def _sets(lines: DataFrame) -> DataFrame:
    """One row for each set: nid in the order of earliest places, digests, copies, size, parity, place, prefix (rarest first)."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "line_no")
    one = lines.groupBy("k1", "k2").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), *[F.first(b).alias(b) for b in _PARITY], F.first("prefix").alias("prefix"))
    order = ["at.last", "at.doc_id", "at.text_hash", "at.line_no", "k1", "k2"]
    return checkpointed(one.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("nid"), "k1", "k2", "copies", "n", *_PARITY, F.col("at.doc_id").alias("at_doc"), F.col("at.text_hash").alias("at_hash"), F.col("at.line_no").alias("at_line"), "prefix"))


def _may_match(percent: int) -> Column:
    """The length, positional and parity filters on x_ and y_."""
    n, m = F.col("x_n"), F.col("y_n")
    least = F.ceil((n + m) * percent / F.lit(100 + percent))
    near = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    left = F.least(n - F.col("x_pos"), m - F.col("y_pos")) >= least
    each = [F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}")) for b in _PARITY]
    apart = F.when((n <= SHORT) == (m <= SHORT), F.bit_count(each[0]) + F.bit_count(each[1])).otherwise(F.bit_count(each[0].bitwiseXOR(each[1])))
    return near & left & (apart <= n + m - 2 * least)


def _named(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])


def _verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The later nids of pairs (early, late) whose whole sets are similar enough."""
    joined = pairs.join(whole.select(F.col("nid").alias("early"), F.col("words").alias("x")), "early").join(whole.select(F.col("nid").alias("late"), F.col("words").alias("y")), "late")
    same = F.size(F.array_intersect("x", "y"))
    return joined.withColumn("same", same).filter(F.col("same") * 100 >= (F.size("x") + F.size("y") - F.col("same")) * percent).select(F.col("late").alias("nid")).distinct()


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _whole(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(nid, words) of the sets in pairs, taken again from the texts at their places."""
    wanted = pairs.select(F.explode(F.array("early", "late")).alias("nid")).distinct().join(sets.select("nid", "at_doc", "at_hash", "at_line"), "nid")
    wanted = checkpointed(wanted)
    row = F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("text_hash") == F.col("at_hash"))
    places = checkpointed(wanted.select("at_doc", "at_hash").distinct())
    texts = _plain(docs).join(_sized(places), row, "left_semi").select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = texts.join(_sized(wanted), row & (F.col("line_no") == F.col("at_line"))).select("nid", "line").dropDuplicates(["nid"])
    return checkpointed(lines.select("nid", _set(F.col("line")).alias("words")), done=[wanted, places])


def _first_leads(rare: DataFrame) -> DataFrame:
    """(p, nid): the earliest set of each word of several sets, and the one with the most copies."""
    often = checkpointed(rare.groupBy("p").agg(F.count(F.lit(1)).alias("sets"), F.min("nid").alias("nid"), F.max("copies").alias("copies")).filter("sets > 1"))
    common = rare.join(often.filter("copies > 1").select("p", "copies"), ["p", "copies"]).groupBy("p").agg(F.min("nid").alias("nid"))
    return often.select("p", "nid").union(common).distinct()


def _led(followers: DataFrame, leads: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (early, late) of a follower and an earlier lead of the same word that may match."""
    met = _named(followers, "y").join(_named(leads, "x"), (F.col("x_p") == F.col("y_p")) & (F.col("x_nid") < F.col("y_nid")) & _may_match(percent))
    return met.select(F.col("x_nid").alias("early"), F.col("y_nid").alias("late")).distinct()


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, line_no of every line to remove, once for rows that agree in doc_id and text."""
    whole = _lines(docs, percent)
    sets = _sets(whole.filter("n > 0"))
    lines = checkpointed(whole.filter("n > 0").select("doc_id", "text_hash", "line_no", "k1", "k2"), done=[whole])
    entries = sets.select("nid", "copies", "n", *_PARITY, F.posexplode("prefix").alias("pos", "p"))
    rare = entries.filter(F.col("pos") < STAR)
    first = checkpointed(_led(rare.drop("copies"), rare.join(_first_leads(rare), ["p", "nid"]).drop("copies"), percent))
    words = _whole(docs, sets, first)
    gone = checkpointed(_verified(first, words, percent), done=[words])
    # no more than SHARE words for each prefix word of a set can be so common
    hot = checkpointed(entries.groupBy("p").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") > max(HOT, sets.count() // SHARE)))
    crowded = entries.drop("copies").join(_sized(hot), "p")
    some = crowded.filter(F.pmod(F.xxhash64("nid", "p"), F.col("sets")) < LEADS)
    more = checkpointed(_led(crowded.join(gone, "nid", "left_anti").drop("sets"), some.drop("sets"), percent).join(first, ["early", "late"], "left_anti"))
    words = _whole(docs, sets, more)
    found = checkpointed(gone.union(_verified(more, words, percent)), done=[gone, words, hot])
    gone = found.withColumn("gone", F.lit(True))
    tried = first.union(more)
    marked = sets.join(_sized(gone), "nid", "left").select("nid", "gone", "n", *_PARITY, F.posexplode("prefix").alias("pos", "p"))
    n = F.col("n")
    x, y = _named(marked.filter(F.col("pos") <= n - F.ceil(2 * n * percent / F.lit(100 + percent))), "x"), _named(marked, "y")
    early, late = F.least("x_nid", "y_nid"), F.greatest("x_nid", "y_nid")
    smaller = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_nid") < F.col("y_nid")))
    left = F.when(F.col("x_nid") < F.col("y_nid"), F.col("y_gone")).otherwise(F.col("x_gone")).isNull()
    second = x.join(y, (F.col("x_p") == F.col("y_p")) & smaller & left & _may_match(percent)).select(early.alias("early"), late.alias("late")).distinct()
    second = checkpointed(second.join(tried, ["early", "late"], "left_anti"), done=[first, more])
    words = _whole(docs, sets, second)
    gone = checkpointed(found.union(_verified(second, words, percent)), done=[found, second, words]).withColumn("gone", F.lit(True))
    verdict = sets.select("nid", "k1", "k2", "at_doc", "at_hash", "at_line").join(gone, "nid", "left")
    told = lines.join(verdict, ["k1", "k2"])
    later = ~(F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("text_hash") == F.col("at_hash")) & (F.col("line_no") == F.col("at_line")))
    return told.filter(later | F.col("gone").isNotNull()).select("doc_id", "text_hash", "line_no")


def line_report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (numbers from 0) of every row of docs."""
    each = removed_lines(docs, percent).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("gone")).select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), "gone")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"))
    out = rows.join(each, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")), "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), gone.alias("removed_lines"))


def without_near_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with the near-duplicate lines taken out of ``text``; texts may become empty."""
    each = removed_lines(docs, percent).groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("__gone")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__gone")
    text = docs["text"].cast("string")
    joined = docs.join(each, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    return joined.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])
