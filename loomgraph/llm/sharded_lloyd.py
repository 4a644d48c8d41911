"""Lloyd's clustering with vectors cut into blocks of columns.

Components are integers, floor(``scale`` x), so all sums are exact and no result depends on an order.  The blocks of
one range of columns (a shard) are a table of their own: its tasks know the shard's slice of the centroids only and give exact
partial squared distances to all of them.  One aggregate by vector adds the blocks and takes the nearest
centroid; each shard then sums its own blocks by cluster and so renews its slice.  What travels is ``k`` partial distances a
block and a narrow table of assignments, which is written each round; a slice is k times the columns of a shard, whatever the rows.

Defined results: vectors of another length, or with a null or non-finite component, are left out; integers are held within
2^27, so that squared distances stay exact; rows of equal id are vectors of their own, a null id is hashed like an empty one; equal hashes are
ordered by the vectors' components; of fewer than k vectors each is a centroid; a sum beyond a long is null; empty tables give an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_or_shuffled

LIMIT = float(1 << 27)
#: Rows whose partial distances are worked out at once.
ROWS = 1024


def whole(x: Column, scale: int) -> Column:
    """floor(scale x), held within LIMIT."""
    return F.floor(F.greatest(F.least(x.cast("double") * float(scale), F.lit(LIMIT)), F.lit(-LIMIT))).cast("int")


def partial_distances(block: DataFrame, slices: np.ndarray) -> DataFrame:
    """(row, id, d0, d1, ...) of one shard's rows (row, id, x): squared distances to each centroid's slice over these columns."""
    k, width = slices.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)
                d = [((x - c) ** 2).sum(1) for c in slices]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), *map(pa.array, d)], names=["row", "id", *[f"d{i}" for i in range(k)]])

    return block.select("row", "id", "x").mapInArrow(step, "row long, id long, " + ", ".join(f"d{i} long" for i in range(k)))


def cluster(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 16, dim: int = 64, rounds: int = 3, shards: int = 4, scale: int = 64, seed: str = "1:") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector after ``rounds`` rounds."""
    spark, scratch, width = vectors.sparkSession, Scratch(vectors.sparkSession), -(-dim // shards)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = vectors.where(F.size(column) == dim).where(F.forall(column, fine)).select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"))
    integers = lambda v: F.transform(v, lambda x: whole(x, scale))
    drawn = kept.select(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h"), integers(F.col("v")).alias("x")).orderBy("h", "x").limit(k).collect()
    centroids = [list(r["x"]) for r in drawn]
    if not centroids:
        return spark.createDataFrame([], f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    cut = F.array(*[F.struct(F.lit(s).alias("shard"), integers(F.slice("v", s * width + 1, min(width, dim - s * width))).alias("x")) for s in range(-(-dim // width))])
    blocks = scratch.write(kept.withColumn("row", F.monotonically_increasing_id()).select("row", "id", F.inline(cut)), by=["shard"])
    shard_of = {s: slice(s * width, min((s + 1) * width, dim)) for s in range(-(-dim // width))}

    def assigned() -> DataFrame:
        """(row, id, cluster, distance): blocks added up by vector, and the first of the nearest centroids."""
        every, parts = np.array(centroids, np.int64), None
        for s, columns in shard_of.items():
            part = partial_distances(blocks.where(F.col("shard") == s), every[:, columns])
            parts = part if parts is None else parts.unionByName(part)
        sums = parts.groupBy("row", "id").agg(F.array(*[F.sum(f"d{i}") for i in range(len(centroids))]).alias("d"))
        return scratch.write(sums.select("row", "id", (F.array_position("d", F.array_min("d")) - 1).cast("int").alias("cluster"), F.array_min("d").alias("distance")))

    for _ in range(rounds):
        now = assigned()
        narrow = small_or_shuffled(now.select("row", "cluster"), now.count())
        sums = blocks.join(narrow, "row").groupBy("shard", "cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(width)])
        for r in sums.collect():  # a row for each shard and centroid
            columns = shard_of[r["shard"]]
            centroids[r["cluster"]][columns] = [r[f"s{i}"] // r["n"] for i in range(columns.stop - columns.start)]
        scratch.drop(now)
    last = assigned()
    inertia = {r["cluster"]: int(r["s"]) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    held = lambda n: n if n < 1 << 63 else None
    rows = [(c, held(inertia[c]), held(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(inertia)]
    about = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows
    return last.join(about, "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
