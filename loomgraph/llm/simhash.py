"""Near-duplicate components by SimHash fingerprints.

A text's words are what lies between ASCII white space, A-Z lower-cased; its features are all runs of three words, repeats
included (the whole sequence where there are fewer words), hashed by XXH64 with seed 42.  A bit of the fingerprint is 1 if more
than half of the hashes have it.

Fingerprints of at most ``distance`` = 2 differing bits are linked.  64 bits are cut into four blocks: two differing bits
leave two blocks untouched, so close fingerprints share one of the six pairs of blocks.  They are joined on these and their Hamming distance is verified.
Only distinct fingerprints are joined, so copies cost nothing, and keys with more than ``CROWD`` of them take a way that is
linear for any crowd: two fingerprints at distance 2 or less have a common neighbour at distance 1 or less, which
shares the blocks, so each member writes itself and its 32 one-bit neighbours outside the key.  Members that
wrote the same value (33 at most) are all within distance 2 of each other and are linked to the smallest of them, which loses nothing for components.

Defined results: null and texts without words have fingerprint zero, linked like any other; repeated rows stay, each with
its component; a component without any id has a null ``component_id``, otherwise null ids are passed over in the
minimum; ids are integers; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bagminhash import components
from .common import Scratch, small_or_shuffled

WORDS, SEED = 3, 42
BLOCKS, BLOCK_BITS, DISTANCE = 4, 16, 2
#: Distinct fingerprints of a key up to which pairs are compared; beyond it links are found by common neighbours.
CROWD = 32
#: Rows of a fingerprint from which it counts as hot: its class is broadcast and not shuffled.
HOT_ROWS = 100_000
#: Hashes whose bits are counted at once.
HASHES = 1 << 15
#: A-Z to a-z, other bytes as they are.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint_of(text: str | None) -> int:
    """The fingerprint of one text, as a signed number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes are split at ASCII white space
    if not words:
        return 0
    ones, n, join, digest = np.zeros(64, np.int64), max(1, len(words) - WORDS + 1), b" ".join, xxhash.xxh64_intdigest
    for at in range(0, n, HASHES):
        part = words[at : at + HASHES + WORDS - 1]
        each = [digest(join(x), SEED) for x in zip(*(part[i:] for i in range(WORDS)), strict=False)] if len(words) >= WORDS else [digest(join(words), SEED)]
        bits = np.unpackbits(np.array(each, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, f long) for each row."""

    @F.pandas_udf("long")
    def of_each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([fingerprint_of(x) for x in part], dtype="int64")

    return docs.select(F.col(key), of_each(F.col(text)).alias("f"))


def block_keys(f: Column) -> Column:
    """One key for each pair of blocks: their 32 bits under the number of the pair."""
    mask = (1 << BLOCK_BITS) - 1
    block = lambda i: F.shiftrightunsigned(f, i * BLOCK_BITS).bitwiseAND(F.lit(mask))
    pairs = combinations(range(BLOCKS), BLOCKS - DISTANCE)
    return F.array(*[F.shiftleft(F.lit(n).cast("long"), 2 * BLOCK_BITS).bitwiseOR(F.shiftleft(block(a), BLOCK_BITS)).bitwiseOR(block(b)) for n, (a, b) in enumerate(pairs)])


def free_bits(key: Column) -> Column:
    """The one-bit masks of the blocks that a key leaves out."""
    masks = [[1 << (b * BLOCK_BITS + i) for b in range(BLOCKS) if b not in kept for i in range(BLOCK_BITS)] for kept in combinations(range(BLOCKS), BLOCKS - DISTANCE)]
    signed = [F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in row]) for row in masks]
    return F.element_at(F.array(*signed), (F.shiftrightunsigned(key, 2 * BLOCK_BITS) + 1).cast("int"))


def links(scratch: Scratch, distinct: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints f within DISTANCE; in crowds only as many as keep all components."""
    members = scratch.write(distinct.select("f", F.explode(block_keys(F.col("f"))).alias("key")))
    sizes = scratch.write(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    met = scratch.write(members.join(small_or_shuffled(sizes, sizes.count()), "key"))
    few, crowd = met.where(F.col("size") <= CROWD).select("key", "f"), met.where(F.col("size") > CROWD)
    pairs = few.select("key", F.col("f").alias("a")).join(few.select("key", F.col("f").alias("b")), "key").where("a < b")
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")
    around = F.concat(F.array("f"), F.transform(free_bits(F.col("key")), lambda m: F.col("f").bitwiseXOR(m)))
    wrote = crowd.select("key", "f", F.explode(around).alias("c")).groupBy("key", "c").agg(F.collect_set("f").alias("fs")).where(F.size("fs") > 1)
    near = wrote.select(F.array_min("fs").alias("a"), F.explode("fs").alias("b")).where("a <> b")
    return scratch.write(pairs.unionByName(near).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint as 16 hexadecimal digits, component_id) for each row."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(fingerprints(docs, key, text))
    distinct = scratch.write(rows.groupBy("f").agg(F.count("*").alias("n"), F.min(key).alias("least")))
    found = scratch.write(components(scratch, links(scratch, distinct.select("f"))))
    roots = found.select(F.col("comp").alias("id"), "comp").distinct().unionByName(found.select("id", "comp"))
    linked = scratch.write(distinct.join(small_or_shuffled(roots, found.count() * 2).withColumnRenamed("id", "f"), "f"))
    least = scratch.write(linked.groupBy("comp").agg(F.min("least").alias("component_id")))
    linked = linked.join(small_or_shuffled(least, least.count()), "comp").select("f", "n", "component_id")
    # rows that share their fingerprint with no other and are in no link are their own component
    alone = distinct.join(small_or_shuffled(roots.select(F.col("id").alias("f")), found.count() * 2), "f", "left_anti").where("n > 1").select("f", "n", F.col("least").alias("component_id"))
    lookup = scratch.write(linked.unionByName(alone))
    hot, rest = F.broadcast(lookup.where(F.col("n") >= HOT_ROWS).drop("n")), lookup.where(F.col("n") < HOT_ROWS).drop("n")  # hot: one in HOT_ROWS rows at most
    there = rows.join(hot, "f").unionByName(rows.join(hot, "f", "left_anti").join(small_or_shuffled(rest, rest.count()), "f", "left").withColumn("component_id", F.when(F.col("component_id").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.col("component_id"))))
    return there.select(key, F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
