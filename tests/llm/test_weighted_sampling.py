import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import weighted_sampling as S


def test_collisions_follow_generalised_jaccard(spark):
    r = np.random.default_rng(4)
    k = 64
    rows, want = [], []
    for g in range(40):
        a, b = (r.integers(0, 6, 30) * r.integers(0, 2, 30) for _ in range(2))
        a[0] = b[0] = 2
        if g % 2:
            b = np.where(r.random(30) < 0.7, a, b)
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        rows += [(g, side, int(i * 7919 + g), int(w)) for side, ws in (("a", a), ("b", b)) for i, w in enumerate(ws) if w]
    terms = spark.createDataFrame(rows, "g long, side string, term long, weight long").withColumn("term", F.xxhash64("term"))
    prints = S.samples(S.with_parameters(terms.withColumn("log_weight", F.ln("weight")), k), ["g", "side"], k).groupBy("g").pivot("side", ["a", "b"]).agg(F.first("fingerprint"))
    got = {x["g"]: x["l"] for x in prints.select("g", S.likeness(F.col("a"), F.col("b"), k).alias("l")).collect()}
    error = np.array([got[g] - w for g, w in enumerate(want)])
    assert abs(error.mean()) < 0.03 and np.abs(error).max() < 0.25


def test_collisions_in_long_texts(spark):
    """Zipf's words: rare ones win as often as their weights say, also where ln(total weight) is large."""
    r = np.random.default_rng(8)
    k, pairs, words, vocabulary = 64, 24, 20_000, 30_000
    p = 1 / np.arange(1, vocabulary + 1)
    p /= p.sum()
    parts, want = [], []
    for g in range(pairs):
        half, rest, other = (r.multinomial(words // 2, p) for _ in range(3))
        a, b = half + rest, half + other
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        for side, ws in (("a", a), ("b", b)):
            seen = np.flatnonzero(ws)
            parts.append(pd.DataFrame({"g": g, "side": side, "term": seen + g * vocabulary, "weight": ws[seen]}))
    terms = spark.createDataFrame(pd.concat(parts)).withColumn("term", F.xxhash64("term"))
    prints = S.samples(S.with_parameters(terms.withColumn("log_weight", F.ln("weight")), k), ["g", "side"], k).groupBy("g").pivot("side", ["a", "b"]).agg(F.first("fingerprint"))
    got = {x["g"]: x["l"] for x in prints.select("g", S.likeness(F.col("a"), F.col("b"), k).alias("l")).collect()}
    want = np.array(want)
    error = np.mean([got[g] - w for g, w in enumerate(want)])
    assert abs(error) < 3.5 * np.sqrt((want * (1 - want)).sum() / k) / pairs, (error, want.mean())


@pytest.mark.parametrize("bucket_rows", [3, 256])
def test_report(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(S, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(S, "GROUP_ROWS", 5)
    r = random.Random(1)
    text = lambda: " ".join(r.choice(["the", "of", "é日", *(f"w{i}" for i in range(50))]) for _ in range(r.randrange(0, 80)))
    rows = [(i * i - 5, text()) for i in range(25)] + [(10_000, ""), (10_001, None), (10_002, "x"), (10_003, "!!"), (10_004, "same text"), (10**15, "same text"), (10**15 + 1, "far away")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("bucket", F.lit(2)).withColumn("copy", F.lit(2)).withColumn("h", F.lit(3))
    got = {x["doc_id"]: x for x in S.edit_report(docs).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    count = lambda s: Counter(w for w in re.split(S.WORDS, s.lower()) if w)
    like = lambda a, b: sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0
    off = []
    for i, (k, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        x = got[k]
        assert x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", following)):
            want = like(count(t), count(other))
            assert x[name] in (0, 1) if want in (0, 1) else abs(x[name] - want) < 4.5 * (want * (1 - want) / 64) ** 0.5 + 0.02
            assert want not in (0, 1) or x[name] == want
            off.append(x[name] - want)
        if edited == t:
            assert x["fingerprint"] == x["edited_fingerprint"]
    assert abs(np.mean(off)) < 0.03
    assert got[10_004]["fingerprint"] == got[10**15]["fingerprint"] and got[10**15]["near_next"] == 1
    assert got[10_000]["fingerprint"] == "0" * 512


def test_average_likeness(spark):
    """Averaged over many texts, both figures of the report follow the generalised Jaccard similarity."""
    r = random.Random(3)
    rows = [(i, " ".join(f"w{i * 15 + r.randrange(60)}" for _ in range(150))) for i in range(30)]
    found = S.edit_report(spark.createDataFrame(rows, "doc_id long, text string"), k=64).orderBy(F.desc("doc_id")).collect()
    count = lambda s: Counter(s.split())
    off = {"near_edited": [], "near_next": []}
    for i, x in enumerate(found):
        t, following = rows[x["doc_id"]][1], rows[found[(i + 1) % len(found)]["doc_id"]][1]
        half = len(t) // 2
        for name, other in (("near_edited", t[: len(t) - half] + following[:half]), ("near_next", following)):
            a, b = count(t), Counter(w for w in re.split(S.WORDS, other) if w)
            off[name].append(x[name] - sum((a & b).values()) / sum((a | b).values()))
    for name, errors in off.items():
        # neighbours share words, so about every fourth text counts
        assert abs(np.mean(errors)) < 4 * 0.5 / (64 * len(found) / 4) ** 0.5, name


def test_outlying_and_missing_ids_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 20)
    texts = [f"text {i} of many" for i in range(400)]
    for ids in ([*range(399), 10**18], [None] * 400, [7] * 400, [-(2**63), *range(399)]):
        docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        sizes = [r["count"] for r in S.with_next(docs, "doc_id", "text").where("copy = 0").groupBy("bucket").count().collect()]
        assert sum(sizes) == 400 and max(sizes) <= 60 and len(sizes) >= 15
    assert S.edit_report(docs).count() == 400


def test_few_rows(spark):
    assert S.edit_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    x = S.edit_report(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect()[0]
    assert x["near_next"] == 1
    both = S.edit_report(spark.createDataFrame([(None, "a b"), (None, "a b"), (5, "q"), (4, "long " * 60_000)], "doc_id long, text string")).collect()
    assert len(both) == 4
    texts = spark.createDataFrame([(1, "a b"), (2, None), (3, "b a")], "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in S.fingerprints(texts).collect()}
    assert prints[1] == prints[3] != prints[2] == "0" * 512


def test_components_do_not_depend_on_their_chunks(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a b b c"), (2, "!"), (3, "c d é")], "doc_id long, text string")
    prints = lambda k: {r["doc_id"]: r["fingerprint"] for r in S.fingerprints(texts, k=k).collect()}
    whole = prints(20)
    assert {len(x) for x in whole.values()} == {160} and whole[2] == "0" * 160
    assert prints(5) == {k: v[:40] for k, v in whole.items()}
    monkeypatch.setattr(S, "CHUNK", 3)
    assert prints(20) == whole
