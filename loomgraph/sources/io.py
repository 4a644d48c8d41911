"""Readers and writers for graphs, raw dataset bundles and measurement tables, and generated graphs."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import delete
from ..operators.prepare import nan_to_null


@dataclass
class Bundle:
    """nodes (id, features, y, split), edges (src, dst), and the column names of each kind."""

    nodes: DataFrame
    edges: DataFrame
    numeric: list[str]
    fraction: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    task: str = "classification"


def read_graph_bundle(spark: SparkSession, folder: str, split: str, meta: dict) -> Bundle:
    """features.csv, targets.csv, split_masks_<split>.csv and edgelist.csv; meta names the columns and the task.

    Fraction columns are listed among the numerical ones too; only the rest are numeric here.
    """
    if split not in ("RL", "RH", "TH", "THI"):
        raise ValueError(f"unknown split {split}")
    fraction, categorical = list(meta.get("fraction_features_names", [])), list(meta.get("categorical_features_names", []))
    numeric = [c for c in meta.get("numerical_features_names", []) if c not in fraction]
    read = lambda name: spark.read.csv(f"{folder}/{name}.csv", header=True)
    features, targets, masks = read("features"), read("targets"), read(f"split_masks_{'TH' if split == 'THI' else split}")
    key = lambda df: F.col(f"`{df.columns[0]}`").cast("long").alias("id")
    x = features.select(key(features), *[F.col(c).cast("double").alias(c) for c in [*numeric, *fraction]], *[F.col(c).cast("double").cast("int").alias(c) for c in categorical])
    y = targets.select(key(targets), F.col(meta["target_name"]).cast("double").alias("y"))
    flag = lambda c: F.lower(F.col(c)).isin("true", "1", "1.0")
    m = masks.select(key(masks), F.when(flag("train"), "train").when(flag("val"), "val").when(flag("test"), "test").alias("split"))
    nodes = nan_to_null(x.join(y, "id").join(m, "id", "left"), [*numeric, *fraction, "y"])
    e = read("edgelist")
    edges = e.select(*[F.col(f"`{c}`").cast("long").alias(n) for c, n in zip(e.columns[:2], ("src", "dst"), strict=True)])
    return Bundle(nodes, edges, numeric, fraction, categorical, meta.get("task", "classification"))


#: The commit record of a processed folder; a folder without it is unfinished.
MANIFEST = "_manifest.json"


def fingerprint(*tables: DataFrame) -> str:
    """A digest of the rows and schemas of input tables, whatever their order: one aggregate each."""
    parts = []
    for df in tables:
        row = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).cast("string"), F.lit("0"))).first()
        parts.append(f"{df.schema.simpleString()}|{row[0]}|{row[1]}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


def spec_folder(root: str, spec: dict) -> str:
    return f"{root}/" + "_".join(f"{k}={v}" for k, v in sorted(spec.items()))


def write_processed(df: DataFrame, root: str, spec: dict, by: list[str] = (), inputs: list[DataFrame] = ()) -> str:
    """Write below root under a folder named by the full transform spec, unless a finished one is there; returns the path.

    The table is written beside, its commit record (spec, schema, fingerprint of the ``inputs``) last, and both are published by one rename.  Folders without a
    record are rebuilt, as are those of another schema or other inputs (given any).  Of two writers the first one's rename wins, the other takes
    its result.
    """
    spark, path = df.sparkSession, spec_folder(root, spec)
    jvm = spark._jvm.org.apache.hadoop.fs
    fs, at = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm.Path(path)
    record = {"spec": {str(k): str(v) for k, v in sorted(spec.items())}, "schema": df.schema.jsonValue(), "inputs": fingerprint(*inputs) if inputs else None}

    def finished() -> bool:
        if not fs.exists(jvm.Path(path, MANIFEST)):
            return False
        stream = fs.open(jvm.Path(path, MANIFEST))  # Spark's readers pass over names that begin with an underscore
        there = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        return there["schema"] == record["schema"] and there["spec"] == record["spec"] and record["inputs"] in (None, there["inputs"])

    if finished():
        return path
    beside = f"{root}/.unfinished-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(beside)
    out = fs.create(jvm.Path(beside, MANIFEST))
    out.write(json.dumps(record).encode())
    out.close()
    if not finished():
        delete(spark, path)
        fs.mkdirs(at.getParent())
        # a rename onto a folder that another writer has just published fails, or moves ours into it
        fs.rename(jvm.Path(beside), at)
    for loser in (beside, f"{path}/{beside.rsplit('/', 1)[-1]}"):
        delete(spark, loser)
    return path


def load_graph(nodes: DataFrame, edges: DataFrame, masks: DataFrame | None = None, random_if_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """Canonical tables: ids as long, x as array<double>, y flat (the first of an array), split from masks' first column set.

    Without masks a split column must exist, or a random split be allowed.
    """
    from ..operators.prepare import random_split

    kinds = dict(nodes.dtypes)
    y = F.get("y", F.lit(0)) if kinds.get("y", "").startswith("array") else F.col("y")
    out = nodes.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), y.alias("y"), *[c for c in nodes.columns if c not in ("id", "x", "y")])
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), *[F.col("w").cast("double").alias("w") for c in edges.columns if c == "w"])
    if masks is not None:
        flat = {c: (F.get(c, F.lit(0)) if t.startswith("array") else F.col(c)) for c, t in masks.dtypes if c in ("train", "val", "test")}
        split = reduce(lambda a, c: a.when(flat[c], c), list(flat)[1:], F.when(flat[next(iter(flat))], next(iter(flat))))
        out = out.drop("split").join(masks.select(F.col("id").cast("long").alias("id"), split.alias("split")), "id", "left")
    elif "split" not in out.columns:
        if not random_if_missing:
            raise ValueError("no masks, no split column, and no random split allowed")
        out = random_split(out)
    return out, e


def read_measurements(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Result files below each other by column name; columns that a file lacks are null there."""
    return union_by_name([spark.read.csv(p, header=True, inferSchema=True) for p in paths])


def union_by_name(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def random_graph(spark: SparkSession, n: int, avg_degree: float, seed: int = 0, kind: str = "uniform") -> DataFrame:
    """(src, dst) edges of a generated graph on ids 0..n-1, the same for the same arguments.

    uniform: n max(1, degree) independent pairs.  undirected: both directions of such pairs and all loops, once each.
    poisson: in-degrees are Poisson, clipped to 1..n-1, with distinct sources other than the node.
    """
    draw = lambda *cols: F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(n))
    if kind in ("uniform", "undirected"):
        edges = spark.range(int(n * max(1, avg_degree))).select(draw("id", F.lit(1)).alias("src"), draw("id", F.lit(2)).alias("dst"))
        if kind == "uniform":
            return edges
        loops = spark.range(n).select(F.col("id").alias("src"), F.col("id").alias("dst"))
        return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(loops).distinct()
    if kind != "poisson":
        raise ValueError(f"unknown kind {kind}")
    import math

    # inverse distribution function over the counts that matter; neighbours walk through a full cycle of the other ids
    u = (F.pmod(F.xxhash64("id", F.lit(3), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    most = int(avg_degree + 12 * math.sqrt(avg_degree + 1) + 12)
    p, total, steps = math.exp(-avg_degree), 0.0, []
    for k in range(most):
        total += p
        steps.append(total)
        p *= avg_degree / (k + 1)
    degree = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda s, v: s + (v < u).cast("int"))
    nodes = spark.range(n).withColumn("k", F.greatest(F.lit(1), F.least(degree, F.lit(n - 1)))).where(F.lit(n > 1))
    each = nodes.select("id", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    start = F.pmod(F.xxhash64("id", F.lit(4), F.lit(seed)), F.lit(max(1, n - 1)))
    return each.select((F.pmod(F.col("id") + 1 + F.pmod(start + F.col("i"), F.lit(max(1, n - 1))), F.lit(n))).alias("src"), F.col("id").alias("dst"))
