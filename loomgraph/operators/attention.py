"""Edge scores, softmax by destination, and the attention aggregations.

Heads lie behind each other in flat arrays.  The softmax over a destination is an aggregate and a join, or one mergeable
aggregate after a maximum, never a window: a hub's edges are pre-aggregated where they are and skewed joins are split.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from ..functions import vectors as V
from ..functions.scratch import written
from .aggregate import gather, zero_filled


def edge_dot(edges: DataFrame, nodes: DataFrame, q: str = "q", k: str = "k", heads: int = 1, width: int | None = None) -> DataFrame:
    """(src, dst, score array by head): q[src] . k[dst] for each edge, worked out in the cells of a grid: no edge carries a vector."""
    d = (width if width is not None else V.width_of(nodes, q)) // heads
    return grid.edge_values(edges.select("src", "dst"), nodes, {q: heads * d}, {k: heads * d}, {"score": _dots(heads, d)})


def _dots(heads: int, d: int):
    return lambda x, y, _: np.einsum("nhd,nhd->nh", x.reshape(len(x), heads, d), y[:, : heads * d].reshape(len(y), heads, d))


def dot_softmax(edges: DataFrame, nodes: DataFrame, q: str = "q", k: str = "k", heads: int = 1, width: int | None = None, grad: str | None = None) -> DataFrame:
    """(src, dst, alpha array by head): edge_softmax of edge_dot, and with ``grad``, an array column of edges by head, gscore as of edge_softmax_backward.

    Scores are cheaper to work out twice than to write and join: the first pass gives a destination's maximum and sums, the second the
    edges' values, both in the cells of a grid, so neither scores nor what a destination needs is shuffled for each edge.
    """
    d = (width if width is not None else V.width_of(nodes, q)) // heads
    edges = written(edges.select("src", "dst", *([F.col(grad).cast("array<double>").alias(grad)] if grad else [])))
    values = {grad: heads} if grad else {}
    n, dots = heads * d, _dots(heads, d)
    stats = written(grid.softmax_stats(edges, nodes, {q: n}, {k: n}, heads, dots, (lambda x, y, e: e) if grad else None, values=values))
    ends = nodes.select("id", k).join(stats, "id")

    def alpha(x: np.ndarray, y: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.exp(dots(x, y, e) - y[:, n : n + heads]) / np.maximum(y[:, n + heads : n + 2 * heads], 1e-16)

    def gscore(x: np.ndarray, y: np.ndarray, e: np.ndarray) -> np.ndarray:
        return alpha(x, y, e) * (e - y[:, n + 2 * heads :] / np.maximum(y[:, n + heads : n + 2 * heads], 1e-16))

    return grid.edge_values(edges, nodes, {q: n}, {k: n, "_m": heads, "_z": heads, "_w": heads}, {"alpha": alpha} | ({"gscore": gscore} if grad else {}), dst_nodes=ends, values=values)


def dot_logsumexp(edges: DataFrame, nodes: DataFrame, q: str = "q", k: str = "k", heads: int = 1, width: int | None = None) -> DataFrame:
    """(id, lse array by head): edge_logsumexp of edge_dot in one pass over the cells of a grid; minus infinity without an incoming edge."""
    d = (width if width is not None else V.width_of(nodes, q)) // heads
    stats = grid.softmax_stats(edges.select("src", "dst"), nodes, {q: heads * d}, {k: heads * d}, heads, _dots(heads, d))
    found = stats.select("id", F.array(*[F.when(F.col("_z")[h] == 0, float("-inf")).otherwise(F.col("_m")[h] + F.ln(F.col("_z")[h])) for h in range(heads)]).alias("lse"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("lse", F.array_repeat(F.lit(float("-inf")), heads)).alias("lse"))


#: Slots of all heads up to which scores are written out as arithmetic that stays in generated code.
UNROLLED = 16


def head_dots(a: Column, b: Column, heads: int, d: int, scale: float = 1.0) -> Column:
    """An array by head: the scaled product of two flat arrays."""
    if heads * d > UNROLLED:
        return V.by_head(a, b, heads, d, lambda x, y: np.einsum("nhd,nhd->nh", x, y) * scale)
    return F.array(*[sum((a[h * d + i] * b[h * d + i] for i in range(d)), F.lit(0.0)) * scale for h in range(heads)])


def edge_softmax(edges: DataFrame, score: str = "score", heads: int | None = None) -> DataFrame:
    """Edges with alpha: exp(score - max) over its sum (at least 1e-16), by destination.

    ``score`` is one number an edge, or with ``heads`` an array of one number a head, each normalised on its own; alpha is of the same form.
    The scored edges are written once: they are read for the maxima, the sums and the result.
    """
    edges = written(edges)
    if heads is None:
        top = edges.groupBy("dst").agg(F.max(score).alias("_m"))
        e = F.exp(F.col(score) - F.col("_m"))
        stats = written(edges.join(top, "dst").groupBy("dst").agg(F.max("_m").alias("_m"), F.sum(e).alias("_s")))  # one row a destination
        alpha = e / F.greatest("_s", F.lit(1e-16))
    else:
        top = edges.groupBy("dst").agg(V.aggregated(F.max, score, heads).alias("_m"))
        es = [F.exp(F.col(score)[h] - F.col("_m")[h]) for h in range(heads)]
        stats = written(edges.join(top, "dst").groupBy("dst").agg(F.first("_m").alias("_m"), F.array(*map(F.sum, es)).alias("_s")))
        alpha = F.array(*[e / F.greatest(F.col("_s")[h], F.lit(1e-16)) for h, e in enumerate(es)])
    return edges.join(stats, "dst").withColumn("alpha", alpha).select(*edges.columns, "alpha")


def edge_logsumexp(edges: DataFrame, nodes: DataFrame, score: str = "score", heads: int | None = None) -> DataFrame:
    """(id, lse) of the scores of incoming edges, minus infinity without one; an array by head with ``heads``."""
    edges = written(edges.select("dst", score))
    scores = [F.col(score)] if heads is None else V.slots(score, heads)
    top = edges.groupBy("dst").agg(*[F.max(x).alias(f"_m{h}") for h, x in enumerate(scores)])
    lse = [F.first(f"_m{h}") + F.ln(F.sum(F.exp(x - F.col(f"_m{h}")))) for h, x in enumerate(scores)]
    found = edges.join(top, "dst").groupBy(F.col("dst").alias("id")).agg((lse[0] if heads is None else F.array(*lse)).alias("lse"))
    none = F.lit(float("-inf")) if heads is None else F.array_repeat(F.lit(float("-inf")), heads)
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("lse", none).alias("lse"))


def softmax_sum(scored: DataFrame, nodes: DataFrame, values: str, heads: int, d: int, heavy_parts: int = 1, hubs: float | None = None) -> DataFrame:
    """(id, out) from rows (src, dst, _s array by head): softmax-weighted sums by destination of the sources' ``values``.

    The narrow scores are written once.  First the maximum by destination and head (partial aggregates), then the values are
    gathered for one aggregate of sum(e) and sum(e v).  With ``heavy_parts`` over 1 the sums are salted by source and merged in a second step.
    """
    scored = written(scored)
    top = scored.groupBy("dst").agg(V.aggregated(F.max, "_s", heads).alias("_m"))
    e = [F.exp(F.col("_s")[h] - F.col("_m")[h]) for h in range(heads)]
    weighted = gather(scored.join(top, "dst").select("src", "dst", F.array(*e).alias("_e")), nodes, {values: "_v"}, hubs=hubs)
    parts = [*[F.sum(F.col("_e")[h]).alias(f"_z{h}") for h in range(heads)], *[F.sum(F.col("_e")[h] * F.col("_v")[h * d + i]).alias(f"_o{h * d + i}") for h in range(heads) for i in range(d)]]
    if heavy_parts > 1:
        first = weighted.groupBy("dst", F.pmod(F.xxhash64("src"), F.lit(heavy_parts)).alias("_part")).agg(*parts)
        sums = first.groupBy("dst").agg(*[F.sum(c).alias(c) for c in first.columns if c not in ("dst", "_part")])
    else:
        sums = weighted.groupBy("dst").agg(*parts)
    out = F.array(*[F.col(f"_o{h * d + i}") / F.greatest(F.col(f"_z{h}"), F.lit(1e-16)) for h in range(heads) for i in range(d)])
    return zero_filled(nodes, sums.select(F.col("dst").alias("id"), out.alias("out")), heads * d)


def gatv2_scores(attn: list[list[float]], slope: float, left: Column, right: Column) -> Column:
    """By head: a_h . LeakyReLU(left + right)."""
    d = len(attn[0])
    if len(attn) * d > UNROLLED:
        w = np.array(attn, float)
        return V.by_head(left, right, len(attn), d, lambda x, y: np.einsum("nhd,hd->nh", np.where(x + y > 0, x + y, (x + y) * slope), w))
    return F.array(*[sum((V.leaky(left[h * d + i] + right[h * d + i], slope) * a for i, a in enumerate(row)), F.lit(0.0)) for h, row in enumerate(attn)])


def gatv2_aggr(edges: DataFrame, nodes: DataFrame, attn: list[list[float]], left: str = "left", right: str = "right", slope: float = 0.2, heavy_parts: int = 1, hubs: float | None = None) -> DataFrame:
    """(id, out): score a_h . LeakyReLU(left[dst] + right[src]), message right[src]; ``hubs`` as in gather, for both ends."""
    heads, d = len(attn), len(attn[0])
    both = gather(gather(edges.select("src", "dst"), nodes, {right: "_v"}, hubs=hubs), nodes, {left: "_l"}, "dst", hubs)
    scored = both.select("src", "dst", gatv2_scores(attn, slope, F.col("_l"), F.col("_v")).alias("_s"))
    return softmax_sum(scored, nodes, right, heads, d, heavy_parts, hubs)


def graph_transformer_aggr(edges: DataFrame, nodes: DataFrame, heads: int = 1, q: str = "q", k: str = "k", v: str = "v", scale: float | None = None, width: int | None = None, heavy_parts: int = 1, hubs: float | None = None) -> DataFrame:
    """(id, out): score q[src] . k[dst] scale, message v[src]; scale is 1 / sqrt(head width) by default."""
    d = (width if width is not None else V.width_of(nodes, q)) // heads
    scale = 1 / math.sqrt(d) if scale is None and d else scale or 0.0
    both = gather(gather(edges.select("src", "dst"), nodes, {q: "_q"}, hubs=hubs), nodes, {k: "_k"}, "dst", hubs)
    return softmax_sum(both.select("src", "dst", head_dots(F.col("_q"), F.col("_k"), heads, d, scale).alias("_s")), nodes, v, heads, d, heavy_parts, hubs)


def gat_scores(nodes: DataFrame, h: str, a: list[list[float]], out: str) -> DataFrame:
    """Nodes with a_h . h for each head: one number a head is all that a GAT score needs of an end."""
    d = len(a[0])
    if len(a) * d > UNROLLED:
        w = np.array(a, float)
        return nodes.withColumn(out, V.by_head(F.col(h), F.col(h), len(a), d, lambda x, _: np.einsum("nhd,hd->nh", x, w)))
    return nodes.withColumn(out, F.array(*[sum((F.col(h)[k * d + i] * x for i, x in enumerate(row)), F.lit(0.0)) for k, row in enumerate(a)]))


def gat_aggr(edges: DataFrame, nodes: DataFrame, a_src: list[list[float]], a_dst: list[list[float]], h: str = "h", slope: float = 0.2, heads: str = "concat", heavy_parts: int = 1, hubs: float | None = None) -> DataFrame:
    """(id, out): score LeakyReLU(a_src . h[src] + a_dst . h[dst]), message h[src]; heads side by side or averaged."""
    n, d = len(a_src), len(a_src[0])
    scored = gat_scores(gat_scores(nodes.select("id", F.col(h).alias("_h")), "_h", a_src, "_a"), "_h", a_dst, "_b")
    both = gather(gather(edges.select("src", "dst"), scored, {"_a": "_a"}, hubs=hubs), scored, {"_b": "_b"}, "dst", hubs)
    score = F.array(*[V.leaky(F.col("_a")[k] + F.col("_b")[k], slope) for k in range(n)])
    out = softmax_sum(both.select("src", "dst", score.alias("_s")), nodes, h, n, d, heavy_parts, hubs)
    if heads == "mean":
        return out.select("id", F.array(*[sum((F.col("out")[k * d + i] for k in range(n)), F.lit(0.0)) / n for i in range(d)]).alias("out"))
    return out
