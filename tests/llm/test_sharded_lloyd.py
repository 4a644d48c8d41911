import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import sharded_lloyd

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, dim, rounds=3):
    kept = [(i, [max(-(2**27), min(2**27, math.floor(64 * x))) for x in v]) for i, v in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centres = [v for _, v in drawn]
    if not centres:
        return []
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min((dist(v, c), n) for n, c in enumerate(centres)) for _, v in kept]
    for _ in range(rounds):
        now = assign()
        for n in range(len(centres)):
            some = [v for (_, v), (_, m) in zip(kept, now, strict=True) if m == n]
            if some:
                centres[n] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    last = assign()
    inertia = [sum(d for d, m in last if m == n) for n in range(len(centres))]
    held = lambda x: x if x < 2**63 else None
    return sorted(((i, n, d, held(inertia[n]), held(sum(inertia)), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, last, strict=True)), key=repr)


def result(spark, rows, **how):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("cluster", F.lit(1)).withColumn("d0", F.lit(1))
    out = sharded_lloyd.cluster(table, **how)
    return sorted(map(tuple, out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.mark.parametrize(("dim", "k", "shards"), [(8, 5, 4), (7, 4, 3), (5, 3, 1), (3, 6, 3)])
def test_equals_brute_force(spark, dim, k, shards):
    r = random.Random(dim)
    centres = [[r.uniform(-3, 3) for _ in range(dim)] for _ in range(4)]
    # halves and quarters give ties and exact bounds of the integers
    rows = [(i, [r.choice([c + r.gauss(0, 0.3), round(4 * c) / 4]) for c in r.choice(centres)]) for i in range(300)]
    rows += [(3, rows[3][1]), (3, rows[7][1]), (None, [0.0] * dim), (None, [1.0] * dim), (900, None), (901, []), (902, [1.0]), (903, [None] + [0.0] * (dim - 1)), (904, [math.inf] + [0.0] * (dim - 1)), (905, [math.nan] * dim), (906, [-0.001] * dim)]
    rows = [(i, v and [x if x is None else float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    assert result(spark, rows, k=k, dim=dim, shards=shards) == brute(rows, k, dim)


def test_few_far_and_no_vectors(spark):
    far = [(1, [1e30, -1e30]), (2, [0.0, 0.0]), (3, [-1e30, 2.0]), (4, [0.5, 0.5])]
    assert result(spark, far, k=2, dim=2, shards=2) == brute(far, 2, 2)
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    assert result(spark, few, k=16, dim=2) == brute(few, 16, 2)
    assert result(spark, [(1, None), (2, [1.0])], dim=2) == [] == result(spark, [], dim=2)
