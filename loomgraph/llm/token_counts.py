"""Token counts of a unigram vocabulary by count-only Viterbi.

Blanks become ``▁`` and one is put in front of a text that isn't empty.  An Aho-Corasick automaton reports every vocabulary piece that
ends at each position; the dynamic program keeps the best score and the number of pieces up to it,
nothing else.  Ties follow the tokenizer: a later start must be strictly better, so of equal paths the longest
last piece wins.  A character that is no piece by itself may also be an unknown, which scores ten less than
the worst piece and counts as many tokens as it has bytes.

A vocabulary file whose scores are merge numbers only (whole numbers) has no probabilities, and none are trained here: its pieces get
the log-probability that Zipf's law (with Mandelbrot's shift) gives to their rank, ln(1 / (rank + SHIFT)) less the logarithm of the sum over all ranks.

Scores are held to multiples of 2^-20.  Their sums are then exact in any order, so, as no piece has a ``▁`` behind another
character, a text's best path is made of the best paths of its words; words are counted once and remembered.  Vocabularies for which that
doesn't hold are counted on whole texts.

Defined results: null and empty texts have 0 tokens; repeated rows are counted alike; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import handing_back, text_slices

META = "▁"
UNIT = re.compile("▁*[^▁]+|▁+")
#: Bytes of words remembered by a worker, about; beyond that the memory starts anew.
REMEMBERED = 16 << 20
#: Scores are multiples of 1 / GRID.
GRID = 1 << 20
SHIFT = 2.7
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; ``least`` is the worst score of any entry, special ones included."""

    scores: dict[str, float]
    least: float


@cache
def load_vocabulary(path: str) -> Vocabulary:
    """The normal pieces of a sentencepiece file: not its control, unknown and byte entries."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    scores = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    if all(s == int(s) for s in scores.values()):
        scores = zipf(scores)
    scores = {p: round(s * GRID) / GRID for p, s in scores.items()}
    return Vocabulary(scores, min(0.0, *scores.values()))


def zipf(ranked: dict[str, float]) -> dict[str, float]:
    """Log-probabilities from places in the order of falling scores."""
    total = math.log(sum(1 / (SHIFT + k) for k in range(len(ranked))))
    return {p: -math.log(SHIFT + k) - total for k, p in enumerate(sorted(ranked, key=ranked.get, reverse=True))}


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.scores, self.unknown = vocabulary.scores, vocabulary.least - UNKNOWN_PENALTY
        self.pieces = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.by_words = all(s * GRID == int(s * GRID) for s in self.scores.values()) and not any(re.search("[^▁]▁", p) for p in self.scores)
        self.known: dict[str, int] = {}
        self.size = 0

    def best(self, text: str) -> int:
        """Number of tokens on the best path."""
        n, scores, unknown = len(text), self.scores, self.unknown
        score, count = [float("-inf")] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        longest = at = 0  # of the pieces that end behind position `at`, the longest on the best path so far

        def unknown_until(stop: int) -> int:
            """The character at each finished position may be an unknown, after all pieces that end behind it."""
            for i in range(at, stop):
                if (c := text[i]) not in scores and unknown + score[i] > score[i + 1]:
                    score[i + 1], count[i + 1] = unknown + score[i], count[i] + len(c.encode("utf-8", "replace"))
            return stop

        for last, (length, own) in self.pieces.iter(text):
            if last > at:
                at, longest = unknown_until(last), 0
            start = last + 1 - length
            total = own + score[start]
            if total > score[last + 1] or (total == score[last + 1] and length > longest):
                score[last + 1], count[last + 1], longest = total, count[start] + 1, length
        unknown_until(n)
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = META + text.replace(" ", META)
        if not self.by_words:
            return self.best(text)
        known, total = self.known, 0
        for unit in UNIT.findall(text):
            n = known.get(unit)
            if n is None:
                if self.size > REMEMBERED:
                    known.clear()
                    self.size = 0
                n = self.best(unit)
                if len(unit) <= 64:
                    known[unit] = n
                    self.size += 180 + 2 * len(unit)
            total += n
        return total


@cache
def counter(path: str) -> Counter:
    return Counter(load_vocabulary(path))


def counts(docs: DataFrame, path: str, text: str = "text", keep: list[str | Column] = ("doc_id",), out: str = "n_tokens") -> DataFrame:
    """The ``keep`` columns of every row with its number of tokens."""

    @F.arrow_udf("long")
    @handing_back
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(path)
        for part in parts:
            yield pa.array([own.count(t) for some in text_slices(part) for t in some], pa.int64())

    return docs.select(*keep, run(F.col(text).cast("string")).alias(out))
