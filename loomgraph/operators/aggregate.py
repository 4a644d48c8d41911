"""Aggregation of neighbour features over incoming edges: out[dst] from x[src].

Every node of ``nodes`` gets a row; without an incoming edge it is all zeros.  Weights that split into a source and a
destination factor never touch the edges: node rows are scaled before the gather, sums after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from ..functions import vectors as V
from ..functions.scratch import written
from .graph import degree_bucket, degrees, edge_weights, transpose


#: Hubs up to which their ids are broadcast to tell light edges from heavy ones, and edges of a hub that meet one copy of its row.
HUBS, HUB_EDGES = 100_000, 10_000


def gather(edges: DataFrame, nodes: DataFrame, columns: dict[str, str], end: str = "src", hubs: float | None = None) -> DataFrame:
    """Edges with columns of the node at one end; {column of nodes: new name}.

    With ``hubs``, a quantile of the degrees at that end, nodes of at least this degree are hubs: their edges are dealt over salts and meet as many
    copies of the hub's row, HUB_EDGES or so each, so that no task gets all edges of one node; the light rest is joined as it is.  The
    result doesn't depend on the quantile.
    """
    side = nodes.select(F.col("id").alias(end), *[F.col(c).alias(n) for c, n in columns.items()])
    if hubs is None:
        return edges.join(side, end)
    edges = written(edges)
    degree = degree_bucket(degrees(edges, nodes, "out" if end == "src" else "in"), hubs)
    heavy = written(degree.where((F.col("bucket") == "heavy") & (F.col("deg") > 0)).select(F.col("id").alias(end), F.ceil(F.col("deg") / HUB_EDGES).cast("int").alias("_copies")))
    n = heavy.count()
    few = F.broadcast(heavy) if n <= HUBS else heavy
    light = edges.join(few.select(end), end, "left_anti").join(side, end)
    other = "dst" if end == "src" else "src"
    dealt = edges.join(few, end).withColumn("_salt", F.pmod(F.xxhash64(other, F.lit(end)), F.col("_copies")).cast("int")).drop("_copies")
    copies = side.join(few, end).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    return light.unionByName(dealt.join(copies, [end, "_salt"]).drop("_salt"))


def zero_filled(nodes: DataFrame, found: DataFrame, width: int, column: str = "out") -> DataFrame:
    """(id, column) for every node, zeros where nothing was found."""
    return nodes.select("id").join(found, "id", "left").withColumn(column, F.coalesce(column, V.zeros(width)))


def _sums(edges: DataFrame, nodes: DataFrame, x: str, weight: str | None, width: int, *more: Column, hubs: float | None = None) -> DataFrame:
    keep = edges.select("src", "dst", *([weight] if weight else []))
    there = gather(keep, nodes, {x: "_x"}, hubs=hubs)
    value = (lambda c: F.sum(c * F.col(weight))) if weight else F.sum
    return there.groupBy(F.col("dst").alias("id")).agg(V.aggregated(value, "_x", width).alias("out"), *more)


def sum_aggr(edges: DataFrame, nodes: DataFrame, x: str = "x", weight: str | None = None, width: int | None = None, hubs: float | None = None) -> DataFrame:
    """The (weighted) sum; ``hubs`` here and below as in gather."""
    width = width if width is not None else V.width_of(nodes, x)
    return zero_filled(nodes, _sums(edges, nodes, x, weight, width, hubs=hubs), width)


def mean_aggr(edges: DataFrame, nodes: DataFrame, x: str = "x", weight: str | None = None, width: int | None = None, hubs: float | None = None) -> DataFrame:
    """The (weighted) sum divided by the number of edges."""
    width = width if width is not None else V.width_of(nodes, x)
    found = _sums(edges, nodes, x, weight, width, F.count("*").alias("_n"), hubs=hubs)
    return zero_filled(nodes, found.select("id", V.scaled(F.col("out"), 1 / F.col("_n")).alias("out")), width)


def _extreme(edges: DataFrame, nodes: DataFrame, x: str, least: bool, return_arg: bool, width: int | None, hubs: float | None) -> DataFrame:
    width = width if width is not None else V.width_of(nodes, x)
    if return_arg and width:  # cells of a grid, which no hub's edges fill alone
        return _args(edges, nodes, x, width, {("out", "arg"): 1 if least else -1})
    there = gather(edges.select("src", "dst"), nodes, {x: "_x"}, hubs=hubs).withColumnRenamed("dst", "id")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)  # noqa: E731  neither NaN nor infinity wins
    pick = F.min if least else F.max
    parts = [V.aggregated(lambda c: F.coalesce(pick(finite(c)), F.lit(0.0)), "_x", width).alias("out")]
    if return_arg:
        parts.append(F.array().cast("array<long>").alias("arg"))
    return zero_filled(nodes, there.groupBy("id").agg(*parts), width)


def _args(edges: DataFrame, nodes: DataFrame, x: str, width: int, wanted: dict[tuple[str, str], int]) -> DataFrame:
    """(id, a value and an arg column for each wanted pair of names): the least (1) or largest (-1) value of each slot, all from one pass over the edges."""
    typed = dict(edges.dtypes)
    found = grid.extremes(written(edges.select("src", "dst")), nodes.select("id", F.col(x).cast("array<double>").alias(x)), x, width, tuple(wanted.values()))
    columns = []
    for k, ((value, arg), sign) in enumerate(wanted.items()):
        at = range(k * width, (k + 1) * width)
        columns += [F.array(*[F.when(F.col("arg")[i].isNotNull(), F.col("v")[i] * sign).otherwise(0.0) for i in at]).alias(value), F.slice("arg", k * width + 1, width).cast(f"array<{typed['src']}>").alias(arg)]
    every = nodes.select("id").join(found.select("id", *columns), "id", "left")
    return every.select("id", *[c for value, arg in wanted for c in (F.coalesce(value, V.zeros(width)).alias(value), arg)])


def min_max_aggr(edges: DataFrame, nodes: DataFrame, x: str = "x", width: int | None = None) -> DataFrame:
    """(id, least, argleast, most, argmost): min_aggr and max_aggr with their args in one pass."""
    return _args(edges, nodes, x, width if width is not None else V.width_of(nodes, x), {("least", "argleast"): 1, ("most", "argmost"): -1})


def min_aggr(edges: DataFrame, nodes: DataFrame, x: str = "x", return_arg: bool = False, width: int | None = None, hubs: float | None = None) -> DataFrame:
    """Smallest value of each slot; with ``return_arg`` also the smallest source id that has it (null without one)."""
    return _extreme(edges, nodes, x, True, return_arg, width, hubs)


def max_aggr(edges: DataFrame, nodes: DataFrame, x: str = "x", return_arg: bool = False, width: int | None = None, hubs: float | None = None) -> DataFrame:
    """Largest value of each slot; with ``return_arg`` also the smallest source id that has it (null without one)."""
    return _extreme(edges, nodes, x, False, return_arg, width, hubs)


def _degree(edges: DataFrame, end: str) -> DataFrame:
    return edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("_deg"))


def _prescaled(edges: DataFrame, nodes: DataFrame, x: str, factor: Column) -> DataFrame:
    """Nodes whose features are scaled by a factor of their out-degree."""
    d = nodes.select("id", x).join(_degree(edges, "src"), "id", "left").withColumn("_deg", F.greatest(F.coalesce("_deg", F.lit(0)), F.lit(1)).cast("double"))
    return d.select("id", V.scaled(F.col(x), factor).alias(x))


def gcn_aggr(edges: DataFrame, nodes: DataFrame, x: str = "x", width: int | None = None, hubs: float | None = None) -> DataFrame:
    """Sum of x[u] / sqrt(out(u) in(v))."""
    width = width if width is not None else V.width_of(nodes, x)
    ready = _prescaled(edges, nodes, x, 1 / F.sqrt("_deg"))
    found = _sums(edges, ready, x, None, width, F.count("*").alias("_n"), hubs=hubs)
    return zero_filled(nodes, found.select("id", V.scaled(F.col("out"), 1 / F.sqrt("_n")).alias("out")), width)


def random_walk_aggr(edges: DataFrame, nodes: DataFrame, x: str = "x", width: int | None = None) -> DataFrame:
    """Sum of x[u] / out(u)."""
    width = width if width is not None else V.width_of(nodes, x)
    return zero_filled(nodes, _sums(edges, _prescaled(edges, nodes, x, 1 / F.col("_deg")), x, None, width), width)


def spmm(edges: DataFrame, nodes: DataFrame, x: str = "x", norm: str = "none", weight: str | None = None, transposed: bool = False, width: int | None = None) -> DataFrame:
    """norm(A) X, or norm(A)^T X with the weights still those of A."""
    weighted = edge_weights(edges, nodes, norm, weight=weight)
    return sum_aggr(transpose(weighted) if transposed else weighted, nodes, x, "w", width)


def dot_aggr(edges: DataFrame, nodes: DataFrame, x: str = "x", width: int | None = None) -> DataFrame:
    """(id, out): sum over incoming edges of x[v] . x[u], as one product with the neighbour sum."""
    sums = sum_aggr(edges, nodes, x, width=width)
    return nodes.select("id", F.col(x).alias("_x")).join(sums, "id").select("id", V.dot(F.col("_x"), F.col("out")).alias("out"))
