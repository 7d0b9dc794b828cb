"""Token counts under a unigram vocabulary, without making the tokens.

A text is segmented so that the sum of its pieces' scores is largest.  An
Aho-Corasick automaton lists every vocabulary piece that ends at each
character; dynamic programming carries only the best score and its number of
pieces.  Ties go to the candidate found first when start positions are walked
in ascending order, so to the longest last piece, as in the public unigram
tokenizers.  A character that no single piece covers may be taken as unknown
at a penalty of 10 below the lowest score; the pieces of an unknown character
are its UTF-8 bytes.

No piece has a word mark after another character, so segmentations of single
words add up to that of the text, and scores are whole numbers, so the sums
are exact and ties fall alike.  Words are therefore counted once and looked
up after that; the look-up table is a bounded cache that never changes a
count.

The vocabulary is a public one whose pieces and scores are read as a unigram
model.  Defined cases: a null or empty text has no tokens; there is no upper
limit on a text; blanks other than the space are ordinary characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that a worker remembers.
CACHE_WORDS = 200_000
#: The mark for a space (a fixed value of the vocabulary).
MARK = "▁"
#: Below the lowest score, for an unknown character (a fixed value).
PENALTY = 10.0

_LOADED: dict[str, Unigram] = {}


class Unigram:
    """Counts pieces; ``pieces`` are (text, score) pairs."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.cut = all(MARK not in p.lstrip(MARK) for p, _ in pieces)
        self.words: dict[str, tuple[float, int]] = {}

    def segment(self, text: str) -> tuple[float, int]:
        """Best score and its number of pieces."""
        n = len(text)
        best, count = [-inf] * (n + 1), [0] * (n + 1)
        best[0], done = 0.0, 0
        known = self.single.issuperset(text)
        for end, (size, score) in self.automaton.iter(text):  # at one end, the longest piece comes first
            end += 1
            if not known and end - 1 > done:
                self._unknown(text, best, count, done, end - 1)
                done = end - 1
            x = best[end - size] + score
            if x > best[end]:
                best[end], count[end] = x, count[end - size] + 1
        if not known:
            self._unknown(text, best, count, done, n)
        return best[n], count[n]

    def _unknown(self, text: str, best: list[float], count: list[int], done: int, end: int) -> None:
        """Offer the unknown character at each position after ``done``, once all pieces that end there are in."""
        for at in range(done + 1, end + 1):
            if text[at - 1] not in self.single and best[at - 1] + self.unknown > best[at]:
                best[at], count[at] = best[at - 1] + self.unknown, count[at - 1] + len(text[at - 1].encode("utf-8", "replace"))

    def count(self, text: str) -> tuple[float, int]:
        """Score and tokens of a whole text; a mark is put before it."""
        if not text:
            return 0.0, 0
        text = MARK + text.replace(" ", MARK)
        if not self.cut:
            return self.segment(text)
        score, tokens, words = 0.0, 0, self.words
        for word in re.findall(f"{MARK}+[^{MARK}]*", text):
            got = words.get(word)
            if got is None:
                got = self.segment(word)
                if len(words) >= CACHE_WORDS:
                    words.clear()
                if len(word) <= 64:
                    words[word] = got
            score += got[0]
            tokens += got[1]
        return score, tokens


def vocabulary_pieces(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces of a public vocabulary with their scores; no control or byte pieces."""
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(held.id_to_piece(i), held.get_score(i)) for i in range(held.get_piece_size()) if not (held.is_control(i) or held.is_unknown(i) or held.is_byte(i) or held.is_unused(i))]


def counter(path: str) -> Unigram:
    """Loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Unigram(vocabulary_pieces(path))
    return _LOADED[path]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_chars, n_tokens, score of every document; no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            chars, tokens, scores = [], [], []
            for raw in batch.column(1):
                text = (raw.as_py() or b"").decode("utf-8", "replace")
                score, n = own.count(text)
                chars.append(len(text))
                tokens.append(n)
                scores.append(score)
            yield pa.record_batch([batch.column(0), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_chars", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(count, "doc_id long, n_chars long, n_tokens long, score double")
