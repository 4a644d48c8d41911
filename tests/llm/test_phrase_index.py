import hashlib
import random
import re

from pyspark.sql import functions as F

from loomgraph.llm import phrase_index as P


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, size=13):
    windows = {}
    for name, t in items:
        w = words(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(name)
    lengths = {len(w) for w in windows}
    out = []
    for k, t in docs:
        w, hit, names = words(t), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= found
        listed = sorted("null" if n is None else str(n) for n in names)
        out.append((k, len(w), len(hit), len(names), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_equals_brute_force(spark):
    r = random.Random(2)
    vocabulary = ["the", "The", "of", "a", "Éa", "éa", "x1", "Z", *(f"w{i}" for i in range(30))]
    text = lambda n: r.choice(["", " ", "..."]) + r.choice([" ", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(n)) + r.choice(["", "!", "  "])
    items = [(i, text(r.choice([1, 3, 12, 13, 14, 40]))) for i in range(25)] + [(100, None), (101, "..."), (102, "the of a " * 10)]
    items.append((103, items[5][1]))
    docs = []
    for i in range(80):
        t = text(r.randrange(0, 150))
        for _ in range(r.randrange(3)):
            w = r.choice(items)[1] or ""
            cut = w[r.randrange(0, 5) :] if r.random() < 0.5 else w
            t = t + " " + cut + " " + text(3)
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, "!!"), (None, items[3][1]), (203, docs[7][1]), (203, docs[7][1]), (204, "the of a " * 400)]
    found = P.contamination(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("words", F.lit(2)), spark.createDataFrame(items, "item_id long, text string"))
    key = lambda x: (x[0] is None, x)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(docs, items), key=key)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert P.contamination(docs, items).collect() == []
    one = P.contamination(spark.createDataFrame([(1, "a b")], docs.schema), items).collect()[0]
    assert (one["n_words"], one["n_hit"], one["contaminated"]) == (2, 0, False)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x green blue"), (2, "blue red x x x x x green"), (3, "green red blue")], "doc_id long, text string")
    got = {tuple(r) for r in P.proximity_matches(docs, spark.createDataFrame([(7, "Red green")], "item_id long, text string"), 3).collect()}
    assert {(d, q) for d, q, _ in got} == {(1, 7), (3, 7)}


def test_repeated_benchmark_rows_are_one_item(spark):
    items = [("i1", "b c"), ("i1", "b c"), ("i2", "d e"), ("i2", "c d"), (None, "e f"), (None, "e f"), ("i3", ""), ("i3", None)]
    docs = [(1, "a b c d e f"), (2, "b c"), (3, "x"), (None, "c d")]
    found = P.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(map(tuple, found), key=key) == sorted(brute(docs, items), key=key)
    assert {(r["doc_id"], r["n_items"]) for r in found} == {(1, 3), (2, 1), (3, 0), (None, 1)}


def near(docs, items, within):
    """Places by looking at every word of every document."""
    terms, docs = {}, set(docs)
    for q, t in items:
        terms.setdefault(q, set()).update(words(t))
    count = {}
    for _, t in docs:
        for w in words(t):
            count[w] = count.get(w, 0) + 1
    out = []
    for q, some in terms.items():
        if some:
            rare = min(some, key=lambda w: (count.get(w, 0), w.encode()))
            for k, t in docs:
                w = words(t)
                out += [(k, q, i) for i, x in enumerate(w) if x == rare and some <= set(w[max(0, i - within) : i + within + 1])]
    return out


def test_proximity_equals_brute_force(spark):
    r = random.Random(6)
    vocabulary = ["the", "of", *(f"w{i}" for i in range(12))]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    docs = [(i, text(r.randrange(60))) for i in range(60)] + [(2, "a q q q"), (2, "b c z"), (None, "a b c x"), (None, "b c"), (None, None), (7, ""), (99, "the " * 3000 + "a b c"), (98, "b a c"), (98, "b a c")]
    items = [(i, text(r.randrange(1, 4))) for i in range(12)] + [(50, "a b c"), (51, "c the"), (50, "a"), (None, "b c"), (52, None), (53, "...")]
    got = P.proximity_matches(spark.createDataFrame(docs, "doc_id long, text string").withColumn("q", F.lit(1)).withColumn("term", F.lit("x")), spark.createDataFrame(items, "item_id long, text string"), 4).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(near(docs, items, 4), key=key)
    assert {x[0] for x in near(docs, items, 4) if x[1] == 50} == {None, 98, 99}
