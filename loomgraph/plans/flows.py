"""Composed flows: scoring a node classifier, preparing a dataset, and the benchmark report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, metrics, nn, prepare, report
from ..sources.io import Bundle


def score_classifier(nodes: DataFrame, edges: DataFrame, layers: list[nn.Layer], head: tuple[nn.Matrix, list[float]], self_loops: bool = True) -> DataFrame:
    """(split, n, accuracy) of a stored model: self-loops, stacked blocks, head, one grouped count."""
    if self_loops:
        edges = graph.add_self_loops(edges, nodes)
    scored = nn.classify(nn.encode(nodes, edges, layers), *head)
    rows = metrics.labelled(scored, F.lit(True))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))


@dataclass
class Prepared:
    """Transformed nodes (id, x, y, split, label_mask), edges, kinds of the slots; snapshots by name if inductive."""

    nodes: DataFrame
    edges: DataFrame
    kinds: list[str]
    snapshots: dict[str, tuple[DataFrame, DataFrame, DataFrame]]
    bins: list[float]


def _numbers(rows: DataFrame, fit_on: DataFrame, columns: list[str], transform: str, how: str | None) -> DataFrame:
    """Fitted with missing values, then imputed, then transformed."""
    if not columns:
        return rows
    if transform in ("standard", "min_max"):
        fitted = prepare.fit_scale(fit_on, columns, transform)
    elif transform.startswith("quantile"):
        fitted = prepare.fit_quantiles(fit_on, columns)
    if how:
        rows = prepare.impute(rows, prepare.fit_impute(fit_on, columns, how))
    if transform in ("standard", "min_max"):
        return prepare.scale(rows, fitted)
    if transform.startswith("quantile"):
        return prepare.quantile_transform(rows, fitted, transform.removeprefix("quantile_"))
    return rows


def prepare_dataset(bundle: Bundle, numeric_transform: str = "quantile_normal", numeric_impute: str | None = "most_frequent", fraction_transform: str = "none", fraction_impute: str | None = "most_frequent", one_hot: bool = True, target_transform: str = "none", bins: tuple[str, int] | None = None, inductive: bool = False, symmetric: bool = False) -> Prepared:
    """Raw columns to features: statistics of all rows, or of training rows where inductive."""
    for value, known in ((numeric_transform, prepare.SCALE), (fraction_transform, prepare.SCALE), (target_transform, ("none", "standard", "min_max")), (numeric_impute, (*prepare.IMPUTE, None)), (fraction_impute, (*prepare.IMPUTE, None))):
        if value not in known:
            raise ValueError(f"unknown option {value}")
    if bins and target_transform != "none":
        raise ValueError("a binned target is not scaled")
    rows, train = bundle.nodes, bundle.nodes.where("split = 'train'")
    fit_on = train if inductive else rows
    edges_of = []
    if bins:
        edges_of = prepare.fit_bins(train.where("y is not null"), "y", *bins)
        rows = rows.withColumn("y", prepare.bin_target(F.col("y"), edges_of))
    elif target_transform != "none":
        rows = prepare.scale(rows, prepare.fit_scale(train, ["y"], target_transform))
    rows = _numbers(rows, fit_on, bundle.numeric, numeric_transform, numeric_impute)
    rows = _numbers(rows, fit_on, bundle.fraction, fraction_transform, fraction_impute)
    categories = prepare.fit_one_hot(fit_on, bundle.categorical) if one_hot else {}
    x, kinds = prepare.feature_vector(bundle.numeric, bundle.fraction, categories)
    if not one_hot and bundle.categorical:
        x = F.concat(x, F.array(*[F.col(c).cast("double") for c in bundle.categorical]))
        kinds += ["cat"] * len(bundle.categorical)
    nodes = rows.select("id", x.alias("x"), "y", "split").withColumn("label_mask", F.col("y").isNotNull() & F.col("split").isNotNull())
    edges = graph.symmetrize(bundle.edges) if symmetric else bundle.edges
    return Prepared(nodes, edges, kinds, prepare.snapshots(nodes, edges) if inductive else {}, edges_of)


def benchmark_report(rows: DataFrame, baseline: str, backends: list[str], measure: str = "forward_ms") -> dict[str, DataFrame]:
    """The tables of a benchmark report: speed-ups, raw times, geometric means, graphs."""
    rows = report.derived(rows)
    table = report.speedup_table(rows, baseline, backends, measure)
    return {
        "speedups": table,
        "raw": report.raw_table(rows, backends, measure),
        "gmeans": report.gmean_speedup(report.to_long(table, report.SETUP), ["backend"]),
        "graphs": graph.graph_summary(rows.select("dataset", "num_nodes", "num_edges")),
    }
