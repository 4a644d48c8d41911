"""Merkle fixity audit of WARC replicas.

Records of a file are ordered by number; each lies at a byte range.  A leaf is the SHA-256 of a record's bytes,
a node the SHA-256 of the ordered numbers, lengths and digests of up to ``FANOUT`` children, so it vouches for an ordered range
of offsets.  A file holds the numbers that share ``number div FANOUT^LEVELS`` and its tree has LEVELS levels.
Two replicas are compared from the roots down; only children of nodes that differ are read
at the next level, which ends at the damaged records and their byte ranges in each replica.

Because a record's place in the tree comes from its number, a lost or added record disturbs one branch
only and not all that follow it.

Defined results: null fields are empty ones; records with
the same number form one leaf, with their lengths added up, from their number and the sums of four parts of their digests (the same in any order
and pre-aggregated: a repeated number is never one long list); a null number counts as -1; a record that
only one replica has is ``missing`` (in the second) or ``extra``; equal replicas and empty tables give an empty result; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

FANOUT, LEVELS = 16, 3


def warc_record(number: Column, url: Column, payload: Column) -> Column:
    """One response record as text: header lines, an empty line, the payload, two line ends."""
    body = F.coalesce(payload.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:record:"), F.coalesce(number.cast("string"), F.lit("-1")),
        F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(records: DataFrame, number: str, record: Column) -> DataFrame:
    """(file, number, length, hash, begin): one row a record number, with its first byte in its file."""
    rows = records.select(F.coalesce(F.col(number).cast("long"), F.lit(-1)).alias("number"), record.alias("_record"))
    rows = rows.select("number", F.octet_length("_record").cast("long").alias("length"), F.sha2("_record", 256).alias("hash"))
    # a number is normally unique: the partial aggregate sends one row each
    parts = [F.sum(F.conv(F.substring("hash", 15 * i + 1, 15), 16, 10).cast("decimal(28,0)")).cast("string").alias(f"s{i}") for i in range(4)]
    rows = rows.groupBy("number").agg(F.sum("length").alias("length"), F.count("*").alias("n"), F.min("hash").alias("hash"), *parts)
    several = F.sha2(F.concat_ws(",", "n", *[f"s{i}" for i in range(4)]), 256)
    rows = rows.select("number", "length", F.when(F.col("n") == 1, F.col("hash")).otherwise(several).alias("hash"))
    rows = rows.withColumn("file", F.floor(F.col("number") / FANOUT**LEVELS).cast("long"))
    before = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", "number", "length", "hash", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("begin"))


def tree(scratch: Scratch, leaf: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to the roots, each written once: (at, hash); node ``at`` has the children at * FANOUT + 0..FANOUT-1."""
    levels = [leaf.select(F.col("number").alias("at"), F.concat_ws(":", F.col("number"), F.col("length"), F.col("hash")).alias("hash"))]
    for _ in range(LEVELS):
        below = levels[-1].groupBy(F.floor(F.col("at") / FANOUT).cast("long").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("c"))
        levels.append(scratch.write(below.select(F.col("parent").alias("at"), F.sha2(F.array_join(F.transform("c", lambda x: F.concat_ws("=", x["at"], x["hash"])), ","), 256).alias("hash"))))
    return levels


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.withColumnRenamed("hash", "hash_b"), "at", "full_outer")
    return both.where(~F.col("hash").eqNullSafe(F.col("hash_b"))).select("at")


def audit(first: DataFrame, second: DataFrame, number: str, record: Column) -> DataFrame:
    """One row for each record that differs between the replicas, with its byte range (end exclusive) and digest in both."""
    scratch = Scratch(first.sparkSession)
    leaf = [scratch.write(leaves(x, number, record)) for x in (first, second)]
    trees = [tree(scratch, x) for x in leaf]
    bad = scratch.write(differing(trees[0][LEVELS], trees[1][LEVELS]))
    for level in range(LEVELS - 1, -1, -1):
        below = [t[level].join(bad.withColumnRenamed("at", "parent"), F.floor(F.col("at") / FANOUT) == F.col("parent"), "left_semi") for t in trees]
        bad = scratch.write(differing(*below))
    a, b = (x.join(bad.withColumnRenamed("at", "number"), "number", "left_semi").select("file", "number", F.col("begin").alias(f"begin_{s}"), (F.col("begin") + F.col("length")).alias(f"end_{s}"), F.col("hash").alias(f"sha256_{s}")) for x, s in zip(leaf, "ab", strict=True))
    status = F.when(F.col("sha256_b").isNull(), "missing").when(F.col("sha256_a").isNull(), "extra").otherwise("changed")
    return a.join(b, ["file", "number"], "full_outer").select("file", "number", status.alias("status"), "begin_a", "end_a", "sha256_a", "begin_b", "end_b", "sha256_b")
