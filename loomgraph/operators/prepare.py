"""Feature preparation: statistics are fitted with one aggregate over the rows given, then applied as a projection.

NaN counts as missing.  A fitted transform is a small driver-side list or dict; fit on all rows for the transductive
setting and on training rows for the inductive one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.positions import column_quantiles, global_positions
from ..functions.vectors import constant, normal_quantile, rank
from .graph import induced_subgraph

IMPUTE = ("mean", "median", "most_frequent")
SCALE = ("none", "standard", "min_max", "quantile_uniform", "quantile_normal")


def nan_to_null(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns})


def fit_impute(rows: DataFrame, columns: list[str], how: str) -> dict[str, float]:
    """Value for missing entries by column: mean, median or most frequent (the smallest of equals)."""
    if how not in IMPUTE:
        raise KeyError(how)
    if not columns:
        return {}
    if how == "median":
        return {c: q[1] if q else None for c, q in column_quantiles(rows, columns, 2).items()}
    if how == "mean":
        return rows.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.c", "x.v")
    counted = long.where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
    found = {r["c"]: r["v"] for r in counted.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("v")).collect()}
    return {c: found.get(c) for c in columns}


def impute(rows: DataFrame, values: dict[str, float]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None})


def fit_scale(rows: DataFrame, columns: list[str], kind: str) -> dict[str, tuple[float, float]]:
    """(shift, divisor) by column: mean and population deviation, or minimum and range; a divisor of 0 becomes 1."""
    a, b = {"standard": (F.avg, F.stddev_pop), "min_max": (F.min, lambda c: F.max(c) - F.min(c))}[kind]
    got = rows.agg(*[f(F.col(c)).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("a", a), ("b", b))]).first()
    return {c: (got[f"a_{c}"] or 0.0, got[f"b_{c}"] or 1.0) for c in columns}


def scale(rows: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: (F.col(c) - a) / b for c, (a, b) in fitted.items()})


def fit_quantiles(rows: DataFrame, columns: list[str], landmarks: int = 1000) -> dict[str, list[float]]:
    """Up to ``landmarks`` evenly spaced quantiles (no more than rows), linearly interpolated, by column."""
    n = min(landmarks, max(2, rows.count()))
    return {c: q or [0.0] * n for c, q in column_quantiles(rows, columns, n - 1).items()}


def quantile_place(x: Column, below: Column, upto: Column, quantiles: list[float], near: float) -> Column:
    """Place of x among evenly spaced quantiles, in [0, 1], from the number of those less than x and at most x."""
    step = 1.0 / (len(quantiles) - 1)
    q = constant(quantiles)
    left, right = F.get(q, below - 1), F.get(q, below)
    inside = F.when(upto > below, (below + upto - 1) / 2 * step).otherwise((below - 1 + F.try_divide(x - left, right - left)) * step)
    u = F.when(x - near <= quantiles[0], 0.0).when(x + near >= quantiles[-1], 1.0).otherwise(inside)
    return F.when(x.isNotNull(), u)


def quantile_transform(rows: DataFrame, fitted: dict[str, list[float]], output: str = "uniform") -> DataFrame:
    """Columns as places among their evenly spaced quantiles; a value on repeated quantiles takes the middle of their places.

    At or below the first a value is 0, at or above the last 1.  Normal output is clipped at about +-5.2.  Null stays null.
    """
    fitted = {c: [float(v) for v in q] for c, q in fitted.items()}
    # step by step, so that no step's expression is repeated within the next
    ranked = rows.withColumns({f"_{kind}_{c}": rank(q, F.col(c), kind == "upto") for c, q in fitted.items() for kind in ("below", "upto")})
    near = 0.0 if output == "uniform" else 1e-7
    placed = ranked.withColumns({c: quantile_place(F.col(c), F.col(f"_below_{c}"), F.col(f"_upto_{c}"), q, near) for c, q in fitted.items()}).select(*rows.columns)
    if output == "uniform":
        return placed
    clipped = placed.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(1e-7), F.least(c, F.lit(1 - 1e-7)))) for c in fitted})
    return clipped.withColumns({c: normal_quantile(F.col(c)) for c in fitted})


def fit_one_hot(rows: DataFrame, columns: list[str], most: int = 10_000) -> dict[str, list]:
    """Sorted categories by column; the first goes if there are just two.  More than ``most`` categories raise ValueError: they make no useful slots."""
    counts = rows.agg(*[F.count_distinct(c).alias(c) for c in columns]).first() if columns else {}
    if over := [c for c in columns if counts[c] > most]:
        raise ValueError(f"more than {most} categories in {', '.join(over)}")
    got = rows.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns]).first() if columns else {}
    return {c: (list(got[c])[1:] if len(got[c]) == 2 else list(got[c])) for c in columns}


def one_hot(value: Column, categories: list) -> Column:
    """1.0 at the category's place; all zeros for an unknown or null value."""
    return F.array(*[F.coalesce((value == c).cast("double"), F.lit(0.0)) for c in categories]) if categories else F.array().cast("array<double>")


def fit_bins(train: DataFrame, y: str, strategy: str, k: int) -> list[float]:
    """Edges of k quantile or uniform bins of the training targets, without repeats, ends widened by 1e-6."""
    if strategy == "quantile":
        edges = column_quantiles(train, [y], k)[y]
    elif strategy == "uniform":
        low, high = train.agg(F.min(y), F.max(y)).first()
        edges = [low + (high - low) * i / k for i in range(k + 1)]
    else:
        raise ValueError(f"unknown strategy {strategy}")
    edges = sorted(set(edges))
    return [edges[0] - 1e-6, *edges[1:-1], edges[-1] + 1e-6]


def bin_target(y: Column, edges: list[float]) -> Column:
    """Number of the bin, clipped to the first and last; null stays null."""
    n = sum(((y >= e).cast("int") for e in edges), F.lit(0)) - 1
    return F.when(y.isNotNull(), F.greatest(F.lit(0), F.least(n, F.lit(len(edges) - 2)))).cast("long")


def random_split(nodes: DataFrame, seed: int = 0, shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """nodes with split train, val or test of exactly int(share n) rows and the rest, in the order of a seeded hash of the id."""
    n = nodes.count()
    a, b = int(shares[0] * n), int(shares[1] * n)
    placed = global_positions(nodes.select("id", F.xxhash64("id", F.lit(seed)).alias("_h")), ["_h", "id"], "_pos")  # narrow rows
    split = F.when(F.col("_pos") < a, "train").when(F.col("_pos") < a + b, "val").otherwise("test")
    return nodes.drop("split").join(placed.select("id", split.alias("split")), "id")


def index_masks(nodes: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """nodes with a boolean column for each table of ids; an id may be in several tables and more than once in one."""
    named = None
    for name, ids in lists.items():
        part = ids.select("id", F.lit(name).alias("_name"))
        named = part if named is None else named.unionByName(part)
    masks = named.groupBy("id").agg(*[F.max(F.col("_name") == name).alias(name) for name in lists])
    return nodes.drop(*lists).join(masks, "id", "left").withColumns({name: F.coalesce(name, F.lit(False)) for name in lists})


def index_split(nodes: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """nodes with split from tables of ids; null where no table has the id, an error where several have (index_masks takes those)."""
    masked = index_masks(nodes.drop("split").select(F.struct(*nodes.drop("split").columns).alias("_node"), "id"), {f"_in{i}": ids for i, ids in enumerate(lists.values())})
    several = sum((F.col(f"_in{i}").cast("int") for i in range(len(lists))), F.lit(0)) > 1
    split = F.when(several, F.raise_error(F.lit("an id is in more than one list")))
    for i, name in enumerate(lists):
        split = split.when(F.col(f"_in{i}"), F.lit(name))
    return masked.select("_node.*", split.alias("split"))


def feature_vector(numeric: list[str], fraction: list[str], categorical: dict[str, list]) -> tuple[Column, list[str]]:
    """The concatenated features and the kind of each slot: num, frac or cat."""
    parts = [F.array(*[F.col(c).cast("double") for c in cs]) for cs in (numeric, fraction) if cs]
    parts += [one_hot(F.col(c), values) for c, values in categorical.items() if values]
    kinds = ["num"] * len(numeric) + ["frac"] * len(fraction) + [k for v in categorical.values() for k in ["cat"] * len(v)]
    return (F.concat(*parts) if parts else F.array().cast("array<double>")), kinds


def snapshots(nodes: DataFrame, edges: DataFrame, y: str = "y") -> dict[str, tuple[DataFrame, DataFrame, DataFrame]]:
    """train in train + val in all: for each, relabelled nodes with label_mask of its own split, induced edges, and ids."""
    out = {}
    for name, keep in (("train", ["train"]), ("val", ["train", "val"]), ("test", None)):
        mask = F.lit(True) if keep is None else F.coalesce(F.col("split").isin(keep), F.lit(False))
        n, e, ids = induced_subgraph(nodes, edges, mask)
        out[name] = n.withColumn("label_mask", F.coalesce((F.col("split") == name) & F.col(y).isNotNull(), F.lit(False))), e, ids
    return out


def check_dataset(nodes: DataFrame, kinds: list[str], y: str | None = None, masks: list[str] = (), mask: str | None = None) -> DataFrame:
    """One row: nodes, repeated ids, features of another length, missing features, rows in more than one of ``masks``, rows of the
    boolean ``mask`` (those to train or score on) without ``y``, and whether each of these is 0."""
    none = F.lit(0).cast("long")
    wrong = lambda c: F.coalesce(F.sum(c.cast("long")), none)
    bad = nodes.agg(
        F.count("*").alias("n_nodes"),
        (F.count("*") - F.count_distinct("id")).alias("n_repeated"),
        wrong(F.size("x") != len(kinds)).alias("n_length"),
        wrong(F.exists("x", lambda v: v.isNull() | F.isnan(v))).alias("n_missing"),
        (wrong(sum((F.coalesce(F.col(m).cast("int"), F.lit(0)) for m in masks), F.lit(0)) > 1) if masks else none).alias("n_overlapping"),
        (wrong(F.coalesce(F.col(mask), F.lit(False)) & (F.col(y).isNull() | F.isnan(F.col(y).cast("double")))) if y and mask else none).alias("n_unlabelled"),
    )
    return bad.withColumn("ok", (F.col("n_repeated") + F.col("n_length") + F.col("n_missing") + F.col("n_overlapping") + F.col("n_unlabelled")) == 0)


def check_snapshots(found: dict[str, tuple[DataFrame, DataFrame, DataFrame]], nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a snapshot: its nodes and edges, ends of edges that are no node of it, nodes of its own split, and whether they are as they should be.

    There are three snapshots; each holds the nodes of its own and all earlier splits, and the test one every node and edge.
    """
    splits = nodes.agg(*[F.coalesce(F.sum((F.col("split") == s).cast("long")), F.lit(0)).alias(s) for s in ("train", "val")], F.count("*").alias("all")).first()
    want = {"train": splits["train"], "val": splits["train"] + splits["val"], "test": splits["all"]}
    n_edges, out = edges.count(), None
    for name, (n, e, ids) in found.items():
        ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).join(n.select("id"), "id", "left_anti").agg(F.count("*").alias("n_loose"))
        labelled = n.agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum(F.col("label_mask").cast("long")), F.lit(0)).alias("n_labelled"))
        row = labelled.join(F.broadcast(e.agg(F.count("*").alias("n_edges")))).join(F.broadcast(ends)).join(F.broadcast(ids.agg(F.count_distinct("node_id").alias("n_ids"))))  # one row each
        ok = (F.col("n_nodes") == want[name]) & (F.col("n_ids") == want[name]) & (F.col("n_loose") == 0) & (F.lit(name != "test") | (F.col("n_edges") == n_edges)) & F.lit(set(found) == set(want))
        row = row.select(F.lit(name).alias("snapshot"), "n_nodes", "n_edges", "n_loose", "n_labelled", ok.alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out
