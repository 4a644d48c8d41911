"""Language identification by one bit-sliced Bloom filter whose slots hold a bitmask of languages.

Every letter of a text is the middle of one character trigram (case folded, each run of other
characters counts as one blank).  A language's profile is the set of trigrams that make up at
least ``min_rate`` of its training trigrams.  All profiles share one filter: slot ``i`` holds a bit
per language, so AND-ing the slots of a trigram's hashes returns every language that contains it.
Per language the hits of a text are counted, corrected for the filter's false positives, and the
largest corrected share decides.

Defined results: a null or letterless text is ``und`` with score 0; ties go to the language with
more training text, then to the smaller name; repeated rows are scored alike.  Input columns other
than the id, the text and (for fitting) the language are not read, so clashing names do no harm.
An empty table gives an empty result; without any training row every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, handing_back, place_in_sample, share_by, text_slices

UNDETERMINED = "und"


@dataclass
class LanguageModel:
    """``planes[p][slot]`` holds the bits of languages 64 p to 64 p + 63; ``fill`` is the share of set slots by language."""

    languages: list[str]
    planes: np.ndarray
    fill: np.ndarray
    hashes: int


@cache
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All trigrams as 63-bit numbers, and how many each text has."""
    folded = [f"{t.lower()}\n" for t in texts]
    points = np.frombuffer("".join(folded).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, folded), np.int64, len(folded)))
    letter = letter_table()[points]
    before = np.concatenate([[0], np.cumsum(letter)])[np.concatenate([[0], ends])]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    line = np.where(letter, points, 0)[keep].astype(np.int64)
    line = np.concatenate([[0], line, [0]])
    middle = np.flatnonzero(line)
    return line[middle - 1] << 42 | line[middle] << 21 | line[middle + 1], np.diff(before)


def slots_of(grams: np.ndarray, slots: int, hashes: int) -> Iterator[np.ndarray]:
    """Double hashing: slot i is h1 + i * h2 in a table of a power of two."""
    x = grams.astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    h1, h2 = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    for i in range(hashes):
        yield ((h1 + np.uint64(i) * h2) & np.uint64(slots - 1)).astype(np.int64)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs_per_lang: int = 4000, min_rate: float = 2e-5, slots: int = 1 << 18, hashes: int = 3) -> LanguageModel:
    """Learn from the rows of ``docs`` with a language.

    The model is fitted on about ``max_docs_per_lang`` documents of each language at most (chosen by
    a hash of the id).  At most 1 / min_rate trigrams of a language reach the driver, whatever the input.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not found:
        return LanguageModel([], np.zeros((0, slots), np.uint64), np.zeros(0), hashes)
    chosen = rows.where(place_in_sample("key") < share_by("lang", {name: min(1.0, max_docs_per_lang / n) for name, n in sorted(found.items())}))

    @handing_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, first = np.array(batch["lang"].to_pylist(), object), 0
            for texts in text_slices(batch["text"]):
                here, first = names[first : first + len(texts)], first + len(texts)
                for name in dict.fromkeys(here):
                    grams, n = np.unique(trigrams([texts[i] for i in np.flatnonzero(here == name)])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    grams = Scratch(docs.sparkSession).write(chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # decreasing training text, then name: argmax takes the first of equals
    languages = sorted(totals, key=lambda name: (-totals[name], name))
    least = share_by("lang", {name: max(1.0, min_rate * n) for name, n in totals.items()})
    kept = grams.where(F.col("n") >= least).select("lang", "gram").toArrow()
    names, codes = np.array(kept["lang"].to_pylist(), object), kept["gram"].to_numpy()
    planes = np.zeros((-(-len(languages) // 64), slots), np.uint64)
    fill = np.zeros(len(languages))
    for k, name in enumerate(languages):
        for at in slots_of(codes[names == name], slots, hashes):
            planes[k // 64, at] |= np.uint64(1 << (k % 64))
        fill[k] = np.count_nonzero(planes[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / slots
    return LanguageModel(languages, planes, fill, hashes)


def scores(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The language and the corrected share of trigrams for each text."""
    grams, n = trigrams(texts)
    ends = np.concatenate([[0], np.cumsum(n)])
    share = np.zeros((max(1, len(model.languages)), len(texts)))
    masks = []
    for plane in model.planes:
        mask = None
        for at in slots_of(grams, model.planes.shape[1], model.hashes):
            mask = plane[at] if mask is None else mask & plane[at]
        masks.append(mask)
    for k in range(len(model.languages)):
        hits = np.diff(np.concatenate([[0], np.cumsum(masks[k // 64] >> np.uint64(k % 64) & np.uint64(1), dtype=np.int64)])[ends])
        false = model.fill[k] ** model.hashes
        share[k] = np.clip((hits / np.maximum(n, 1) - false) / max(1e-9, 1 - false), 0, 1)
    best = share.argmax(0)
    known = (n > 0) & (len(model.languages) > 0)
    return [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, known, strict=True)], np.where(known, share.max(0), 0.0)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str | Column] = ("doc_id",), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The ``keep`` columns of every row with the language and its share, under the names ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 bytes a slot and plane: a size fixed by parameters

    @F.arrow_udf("lang_pred string, score double")
    @handing_back
    def guess(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            names, values = [], [np.zeros(0)]
            for texts in text_slices(part):
                a, b = scores(shared.value, texts)
                names += a
                values.append(b)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(values))], ["lang_pred", "score"])

    found = docs.select(F.struct(*keep).alias("kept"), guess(F.col(text).cast("string")).alias("found"))
    return found.select("kept.*", F.col("found.lang_pred").alias(out[0]), F.col("found.score").alias(out[1]))
