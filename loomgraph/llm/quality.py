"""Quality classifier by compression.

Two zstandard dictionaries hold pieces of texts labelled good and bad.  A text like the good texts
compresses better with the good dictionary.  The whole text is compressed in pieces of ``PIECE`` bytes with both; the
difference of the compressed sizes over the size of the text is turned into a score by a logistic curve fitted on
further labelled texts, whole ones too.

Defined results: null and empty texts have no compressed size to compare and get the share of good
labels as score; repeated rows are scored alike; a label holds for every row of its id, null ids have none; extra columns are
not read; an empty table gives an empty result.  Without at least two different texts of both labels every score is the share of good
labels (0.5 without any label).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, handing_back, place_in_sample, share_by, small_or_shuffled, text_slices

#: Bytes of a text that are compressed at once: each piece meets the dictionary anew, so that long texts do not only learn from themselves.
PIECE = 1024
LEVEL = 12
#: Bytes of one excerpt in a dictionary.
EXCERPT = 64


@dataclass
class QualityModel:
    """Score: 1 / (1 + exp(-(slope * difference + constant))); ``prior`` for texts without a size."""

    good: bytes
    bad: bytes
    slope: float
    constant: float
    prior: float


class Sizes:
    """Compressors with the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=18)
        self.by = []
        for content in (good, bad):
            known = zstandard.ZstdCompressionDict(content or b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=params)
            self.by.append(zstandard.ZstdCompressor(compression_params=params, dict_data=known))

    def difference(self, text: str) -> float:
        """(compressed size with the bad dictionary - with the good one) / size; NaN for the empty text."""
        data = text.encode("utf-8", "replace")
        good, bad = (sum(len(c.compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE)) for c in self.by)
        return (bad - good) / len(data) if data else math.nan


def excerpts(data: bytes, size: int) -> bytes:
    """The text, or excerpts of at most ``size`` bytes together, at equal distances from its start to its end."""
    if len(data) <= size:
        return data
    n = max(1, size // (EXCERPT + 1))
    width = min(size, EXCERPT)
    return b"\n".join(data[(len(data) - width) * i // max(1, n - 1) :][:width] for i in range(n))


def share_of_each(lengths: list[int], size: int) -> int:
    """Bytes that each text may give so that all of them fill ``size`` bytes: short texts are whole."""
    low, high = 1, max(lengths, default=1)
    while low < high:
        middle = (low + high + 1) // 2
        if sum(min(n, middle) + 1 for n in lengths) <= size:
            low = middle
        else:
            high = middle - 1
    return low


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for a ridge logistic regression; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def differences(texts: DataFrame, good: bytes, bad: bytes, text: str, *keep: str) -> DataFrame:
    """``keep`` and each text's size difference as ``d``."""
    shared = texts.sparkSession.sparkContext.broadcast((good, bad))  # dict_bytes each

    @F.arrow_udf("double")
    @handing_back
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes = Sizes(*shared.value)
        for batch in batches:
            yield pa.array([sizes.difference(t) for part in text_slices(batch) for t in part], pa.float64())

    return texts.select(*keep, rate(F.col(text).cast("string")).alias("d"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", max_docs_per_label: int = 3000, dict_bytes: int = 250_000) -> QualityModel:
    """Learn from the texts of ``docs`` that ``labels`` (key, label 0 or 1) marks.

    Fitted on a bounded sample of labelled rows: about ``max_docs_per_label`` of each label at most, chosen by a hash of the
    key, each with its whole text.  Every other text (in the order of a hash) gives excerpts to its label's dictionary, the others fit
    the curve.  Keys and sizes of the sample, the dictionaries and one number a text come to the driver, no whole texts.
    """
    scratch = Scratch(docs.sparkSession)
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    odds = math.log((prior + 1e-6) / (1 - prior + 1e-6))
    some = scratch.write(marked.where(place_in_sample("key") < share_by("label", {q: min(1.0, max_docs_per_label / n) for q, n in counts.items()})))
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0).join(small_or_shuffled(some, some.count()), "key")
    texts = scratch.write(texts.select("label", "text", F.xxhash64("text").alias("h")))
    sizes: dict[int, list[tuple[int, int]]] = {0: [], 1: []}
    for r in texts.select("label", "h", F.octet_length("text").alias("n")).distinct().collect():
        sizes[r["label"]].append((r["h"], r["n"]))
    if min(map(len, sizes.values())) < 2:
        return QualityModel(b"", b"", 0.0, odds, prior)
    in_dictionary = {q: dict(sorted(found)[::2]) for q, found in sizes.items()}
    room = {q: share_of_each(list(x.values()), dict_bytes) for q, x in in_dictionary.items()}

    @F.arrow_udf("binary")
    @handing_back
    def excerpt(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for q, h, t in batches:
            rows, at = [], 0
            for part in text_slices(t):
                for one in part:
                    own = q[at].as_py()
                    rows.append(excerpts(one.encode("utf-8", "replace"), room[own]) if h[at].as_py() in in_dictionary[own] else None)
                    at += 1
            yield pa.array(rows, pa.binary())

    chosen = texts.withColumn("e", excerpt("label", "h", "text"))
    pieces = {(r["label"], r["h"]): bytes(r["e"]) for r in chosen.where("e is not null").select("label", "h", "e").collect()}  # dict_bytes a label
    bad, good = (b"\n".join(pieces[q, h] for h in sorted(in_dictionary[q]))[-dict_bytes:] for q in (0, 1))
    found = sorted((r["label"], r["d"]) for r in differences(chosen.where("e is null"), good, bad, "text", "label").collect())
    y, x = np.array(found, float).T
    scale = x.std() + 1e-9
    slope, constant = logistic((x - x.mean())[:, None] / scale, y)
    share = y.mean()  # the sample may hold the labels in other shares than the table
    constant += odds - math.log((share + 1e-6) / (1 - share + 1e-6)) - slope * x.mean() / scale
    return QualityModel(good, bad, slope / scale, constant, prior)


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row with ``score``: the probability of label 1."""
    found = differences(docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text")), model.good, model.bad, "text", "kept")
    value = 1 / (1 + F.exp(-(F.col("d") * model.slope + model.constant)))
    return found.select("kept.*", F.when(F.isnan("d"), model.prior).otherwise(value).alias("score"))
