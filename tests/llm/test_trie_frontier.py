import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from loomgraph.llm import trie_frontier
from loomgraph.llm.common import Scratch, with_workers

SCHEMA = "doc_id long, text string"


def counted(rows):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate({k: k + 32 for k in range(65, 91)})):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                c[run] += 1
    return {w: n for w, n in c.items() if n >= 2}


def near(words):
    """Words at one edit, from the texts that are left without each code point."""
    left = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            left["=", k, w[:k] + w[k + 1 :]].add(w)
            left["<", w[:k] + w[k + 1 :]].add(w)
        left["<", w].add(w)
    out = {w: set() for w in words}
    for key, some in left.items():
        for a in some:
            out[a] |= {b for b in some if a != b and (len(a) == len(b) if key[0] == "=" else {a, b} & {key[1]})}
    return out


def brute(rows):
    n = counted(rows)
    close, form = near(n), {}
    for w in n:
        best = min(((-n[v], v) for v in close[w]), default=None)
        if best and -best[0] >= 10 * n[w]:
            form[w] = best[1]

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(close[w]), n[form[w]] if w in form else None) for w in n}


def result(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    return [tuple(r) for r in trie_frontier.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_equals_brute_force(spark):
    with_workers(spark)
    r = random.Random(5)
    base = ["".join(r.choice("aabéßcÏ") for _ in range(r.randrange(6, 11))) for _ in range(60)]
    rows = []
    for i in range(1500):
        words = []
        for _ in range(30):
            w = base[int(60 * r.random() ** 3)]
            if r.random() < 0.2:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abcé") + w[k + r.randrange(2) :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, "  ,".join(words)))
    rows += [(None, "aaaaaaaa aaaaaaa, aaaaaaaaa aaaaaaaaa"), (None, None), (7, ""), (8, "cafécafé x1y2 " * 3), (8, "cafécafé x1y2 " * 3)]
    got, want = result(spark, rows), brute(rows)
    assert len(got) == len(want) and set(got) == want
    assert sum(f is not None for _, f, *_ in want) > 20 and any(root != f for _, f, root, *_ in want if f)


def test_long_words_are_compared_whole(spark):
    with_workers(spark)
    r = random.Random(2)
    long = "".join(r.choice("ab") for _ in range(20_000))
    some = [long, long[:9000] + "c" + long[9001:], long + "z", long[1:], "a" * 48, "a" * 49, "a" * 50, "a" * 47, "a" * 48 + "b", "b" + "a" * 48, "x" * 60]
    words = spark.createDataFrame([(w, 3) for w in some], "word string, n long")
    got = {(r["word"], r["near"]) for r in trie_frontier.near_words(Scratch(spark), words).collect()}
    assert got == {(a, b) for a, v in near(some[4:]).items() for b in v} | {(long, x) for x in some[1:4]} | {(x, long) for x in some[1:4]}


def test_without_words(spark):
    with_workers(spark)
    assert result(spark, [(1, "short words only"), (2, None), (None, "")]) == []
    assert result(spark, [(1, "aloneword aloneword")]) == [("aloneword", None, "aloneword", 2, 0, None)]
    assert trie_frontier.variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_any_partitioning_gives_the_same(spark):
    with_workers(spark)
    r = random.Random(9)
    words = {"".join(r.choice("ab") for _ in range(r.randrange(7, 10))) for _ in range(300)}
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    want = {(a, b) for a, v in near(words).items() for b in v}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = [(x["word"], x["near"]) for x in trie_frontier.near_words(Scratch(spark), table).collect()]
            assert len(got) == len(want) and set(got) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
