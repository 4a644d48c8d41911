import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bagminhash as B


def bag(text):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in (text or "")))
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def sample(seed=5, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randrange(1, 5)))
    texts = [" ".join(word() for _ in range(r.randrange(1, 120))) for _ in range(n)]
    for i in range(n):
        words = texts[r.randrange(n)].split()
        for _ in range(r.randrange(0, 4)):
            words[r.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += ["", None, "!!! ...", "One two", "one, TWO", "a b c d e " * 500, "a b c d e " * 501, "a b c d e " * 300]
    return texts


def test_similarities_are_exact():
    texts = sample()
    pairs = list(combinations(range(len(texts)), 2))
    got = B.similarities(pa.array([texts[a] for a, _ in pairs]), pa.array([texts[b] for _, b in pairs]))
    want = [jaccard(bag(texts[a]), bag(texts[b])) for a, b in pairs]
    assert np.allclose(got, want)


def test_signatures_are_unbiased_for_counts():
    r = np.random.default_rng(1)
    for low in (1, 9, 100):
        w = np.minimum(r.integers(0, 4, (2, 60)) * r.integers(1, low + 1, (2, 60)), 300)
        seeds = B.mixed(r.integers(1, 1 << 60, 60).astype(np.uint64))
        text, at = np.nonzero(w)
        m = 4000
        sig = B.signatures(text, seeds[at], w[text, at], 2, m)
        want = np.minimum(*w).sum() / np.maximum(*w).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5


@pytest.mark.parametrize("small", [2, 64])
def test_classes_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(B, "SMALL", small)
    texts = sample()
    rows = list(enumerate(texts)) + [(None, "one two"), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(0)).withColumn("class_id", F.lit(9))
    found = B.near_duplicates(docs).collect()
    assert [(r["class_id"], r["representative"]) for r in found if r["doc_id"] is None] == [(None, True)]
    got = {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] is not None}
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    bags = [bag(t) for t in texts]
    for a, b in combinations(range(len(texts)), 2):
        if jaccard(bags[a], bags[b]) >= 0.8 and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in range(len(texts))}


def test_a_group_of_copies_is_one_class(spark):
    base = " ".join(f"w{i}" for i in range(200)).split()
    rows = []
    for i in range(300):
        words = list(base)
        words[i % 200] = "x"
        words[(i * 7) % 200] = f"y{i % 11}"
        rows.append((i, " ".join(words)))
    found = B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 300 and {r["class_id"] for r in found} == {0} and sum(r["representative"] for r in found) == 1


def test_empty_table(spark):
    assert B.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_around_one_boilerplate_stay_apart(spark):
    """Two thirds in common give large buckets in which next to nothing belongs together; the few links there are found."""
    r = random.Random(9)
    shared = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join([*shared, *(f"u{r.randrange(10**6)}" for _ in range(50))])) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + f" z{i}") for i in range(0, 40, 8)]
    got = {x["doc_id"]: x["class_id"] for x in B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 1000 for i, _ in rows}


def test_null_and_other_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert [tuple(r) for r in B.near_duplicates(docs).collect()] == [(None, None, True)] * 3
    with pytest.raises(TypeError):
        B.near_duplicates(docs.withColumn("doc_id", F.lit("x")))


def test_rare_buckets_make_few_pairs_of_texts_below_the_threshold(spark, monkeypatch):
    """Texts of one boilerplate, each without other words of it: their rarest shingles meet in nearly all pairs, next to none of which is verified; those that reach the threshold are."""
    r = random.Random(4)
    base, rows = [f"w{i}" for i in range(300)], []
    for i in range(120):
        words = list(base)
        for k in r.sample(range(300), 9):
            words[k] = f"y{r.randrange(3)}"
        rows.append((i, " ".join(words)))
    rows += [(1000, rows[7][1] + " z"), (1001, rows[70][1].replace("w5 ", "q "))]
    scratch = B.Scratch(spark)
    texts = spark.createDataFrame(rows, "id long, text string")
    monkeypatch.setattr(B, "PARITIES", 256)
    rare = scratch.write(B.rare_buckets(scratch, texts, texts, 0.8))
    pivots = rare.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("placea"), F.col("parities").alias("paritiesa"))
    met = rare.join(pivots, "key").where("id < a")
    pairs = lambda df: {tuple(x) for x in df.select("id", "a").distinct().collect()}
    bags = {i: bag(t) for i, t in rows}
    similar = {(a, b) for a, b in combinations(bags, 2) if jaccard(bags[a], bags[b]) >= 0.8}
    left = pairs(met.where(B.may_reach(0.8)))
    assert {(7, 1000), (70, 1001)} <= similar <= left
    assert len(pairs(met)) > 3000 and len(left - similar) < 600
    order = B.frequent_tokens(scratch, texts)
    monkeypatch.setattr(B, "FREQUENT", 20)
    few = B.frequent_tokens(scratch, texts)
    assert len(few[0]) <= 20 < len(order[0]) and set(few[0]) <= set(order[0])


def test_rare_buckets_make_no_rows_of_tokens_of_one_text(spark, monkeypatch):
    """All tokens of a text that no other text shares stay in packed blocks; shared ones become one row for each text that has them, however they are dealt."""
    r = random.Random(6)
    shared = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*shared, *(f"u{i}v{k}" for k in range(60))])) for i in range(80)]
    rows += [(100 + i, rows[i][1] + f" z{r.randrange(9)}") for i in range(3)] + [(200, ""), (0, "another text of the id of the first one")]
    scratch = B.Scratch(spark)
    texts = spark.createDataFrame(rows, "id long, text string").repartition(5)
    made, write = [], B.Scratch.write
    monkeypatch.setattr(B.Scratch, "write", lambda self, df, *a: made.append(write(self, df, *a)) or made[-1])
    found = []
    for tokens in (1 << 18, 16):
        monkeypatch.setattr(B, "PART_TOKENS", tokens)
        found.append(sorted(tuple(x) for x in B.rare_buckets(scratch, texts, texts, 0.8).collect()))
        if len(found) == 1:
            most = max(df.count() for df in made if "token" not in df.columns)  # counts of frequent tokens aside
    assert found[0] == found[1]
    assert {i for _, i, *_ in found[0]} == {0, 1, 2, 100, 101, 102}
    keys = [k for k, *_ in found[0]]
    assert len(found[0]) > 100 and min(keys.count(k) for k in set(keys)) > 1
    assert most < len(rows) + len(found[0])
