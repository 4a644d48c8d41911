import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import simhash
from loomgraph.llm.common import Scratch, with_workers

SCHEMA = "doc_id long, text string"


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    some = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """Component of each fingerprint, from all pairs."""
    some = sorted(set(prints))
    comp = {f: f for f in some}

    def top(f):
        while comp[f] != f:
            f = comp[f]
        return f

    for i, a in enumerate(some):
        for b in some[:i]:
            if (a ^ b).bit_count() <= 2:
                comp[top(a)] = top(b)
    return {f: top(f) for f in some}


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    comp = classes(prints)
    least = {}
    for (i, _), f in zip(rows, prints, strict=True):
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    return sorted(((i, f"{f:016x}", least.get(comp[f])) for (i, _), f in zip(rows, prints, strict=True)), key=repr)


def result(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("f", F.lit(1)).withColumn("n", F.lit("x")).withColumn("component_id", F.lit(0))
    return sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr)


def test_equals_brute_force(spark):
    with_workers(spark)
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["a", "B", "cé", "d\tE", " "]) for _ in range(r.randrange(5)))) for i in range(400)]
    long = [f"w{r.randrange(3000)}" for _ in range(4000)]
    for i in range(60):
        copy = list(long)
        for _ in range(r.randrange(4)):
            copy[r.randrange(len(copy))] = "new"
        rows.append((1000 - i, " ".join(copy)))
    rows += [(5000, None), (4999, ""), (-3, " \n"), (None, "one two three four"), (None, "one two three four"), (None, "six"), (7, "six"), (7, "six"), (8, "x" * 300_000), (9, " wide  blank")]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    with_workers(spark)
    assert result(spark, []) == []
    assert result(spark, [(None, None)]) == [(None, "0" * 16, None)]


def test_crowded_blocks_lose_no_component(spark):
    """Hundreds of fingerprints share half of their bits: chains of close ones must come out as from all pairs."""
    r = random.Random(8)
    prints = {r.getrandbits(64) for _ in range(200)}
    for shift in (0, 16, 32, 48):
        f = r.getrandbits(64)
        for _ in range(250):
            prints.add(f)
            for _ in range(r.choice([1, 2, 2, 3])):
                f ^= 1 << (shift + r.randrange(16))
    signed = {f - (1 << 64) if f >> 63 else f for f in prints}
    found = simhash.links(Scratch(spark), spark.createDataFrame([(f,) for f in signed], "f long")).collect()
    mask = (1 << 64) - 1
    assert all(((x["a"] ^ x["b"]) & mask).bit_count() <= 2 for x in found)
    comp = {f: f for f in prints}

    def top(f):
        while comp[f] != f:
            f = comp[f]
        return f

    for x in found:
        comp[top(x["a"] & mask)] = top(x["b"] & mask)
    same = classes(prints)
    assert len({top(f) for f in prints}) == len(set(same.values())) < len(prints)
    assert len({(top(f), same[f]) for f in prints}) == len(set(same.values()))


def test_fingerprint_of_long_texts():
    r = np.random.default_rng(1)
    text = " ".join(map(str, r.integers(0, 50, simhash.HASHES + 5)))
    assert simhash.fingerprint_of(text) & ((1 << 64) - 1) == fingerprint(text)
