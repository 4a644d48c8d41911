"""Gradients of the aggregations, as gathers and groupings of their own.

``grad`` tables are (id, g) with the gradient of a result; results name their gradients after the inputs.
Per-edge work happens once; then one aggregate by each end that gets a gradient.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from ..functions import vectors as V
from ..functions.scratch import written
from .aggregate import spmm, zero_filled
from .attention import edge_softmax, gat_scores


def minmax_backward(arg: DataFrame, grad: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(id, gx): each slot's gradient goes to the source that won it; ``arg`` is (id, arg) of min_aggr or max_aggr."""
    each = arg.join(grad, "id").select(F.explode(F.arrays_zip("arg", "g", F.sequence(F.lit(0), F.lit(width - 1)).alias("k"))).alias("z")).select(F.col("z.arg").alias("id"), F.col("z.g").alias("g"), F.col("z.k").alias("k"))
    won = each.where("id is not null")
    found = won.groupBy("id").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("k") == i, F.col("g"))), F.lit(0.0)) for i in range(width)]).alias("gx"))
    return zero_filled(nodes, found, width, "gx")


def spmm_backward(edges: DataFrame, nodes: DataFrame, grad: DataFrame, norm: str = "none", weight: str | None = None, width: int | None = None) -> DataFrame:
    """(id, gx) = norm(A)^T g, weighted before it is transposed."""
    return spmm(edges, nodes.select("id").join(grad, "id"), "g", norm, weight, True, width).withColumnRenamed("out", "gx")


def edge_softmax_backward(edges: DataFrame, alpha: str = "alpha", grad: str = "galpha", heads: int | None = None) -> DataFrame:
    """Edges with gscore = alpha (galpha - sum over the destination of alpha galpha); arrays by head with ``heads``."""
    edges = written(edges)
    if heads is None:
        sums = edges.groupBy("dst").agg(F.sum(F.col(alpha) * F.col(grad)).alias("_s"))
        back = F.col(alpha) * (F.col(grad) - F.col("_s"))
    else:
        sums = edges.groupBy("dst").agg(F.array(*[F.sum(F.col(alpha)[h] * F.col(grad)[h]) for h in range(heads)]).alias("_s"))
        back = F.array(*[F.col(alpha)[h] * (F.col(grad)[h] - F.col("_s")[h]) for h in range(heads)])
    return edges.join(sums, "dst").withColumn("gscore", back).select(*edges.columns, "gscore")


def _attended(edges: DataFrame, sources: DataFrame, destinations: DataFrame, at_src: dict[str, int], at_dst: dict[str, int], heads: int, score: Callable, back: Callable, sums: Callable, widths: tuple[int, int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sums by source, by destination and over all edges (grid.end_sums) of what a softmax by destination hands back.

    ``score(x, y)`` and ``back(x, y)``, the gradient of alpha, are matrices by head from the rows of both ends; ``sums(x, y, alpha, ds)`` gives what is
    added up, with ds = alpha (back - sum over the destination of alpha back).  Two passes over the cells of a grid: one for a destination's
    maximum and sums, one for the sums by end; edges are shuffled as pairs of ids only.
    """
    edges = written(edges.select("src", "dst"))
    n = sum(at_dst.values())
    stats = written(grid.softmax_stats(edges, sources, at_src, at_dst, heads, lambda x, y, _: score(x, y), lambda x, y, _: back(x, y), dst_nodes=destinations))

    def work(x: np.ndarray, y: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, ...]:
        top, z, w = (y[:, n + k * heads : n + (k + 1) * heads] for k in range(3))
        z = np.maximum(z, 1e-16)
        alpha = np.exp(score(x, y) - top) / z
        return sums(x, y, alpha, alpha * (back(x, y) - w / z))

    return grid.end_sums(edges, sources, at_src, at_dst | {"_m": heads, "_z": heads, "_w": heads}, work, widths, dst_nodes=destinations.join(stats, "id"))


def _cut(nodes: DataFrame, found: DataFrame, names: dict[str, int]) -> DataFrame:
    """(id, names): the pieces of v for every node, zeros where nothing was found."""
    out, at = nodes.select("id").join(found, "id", "left"), 1
    for name, w in names.items():
        out, at = out.withColumn(name, F.coalesce(F.slice("v", at, w), V.zeros(w))), at + w
    return out.drop("v")


def gt_backward(edges: DataFrame, nodes: DataFrame, grad: DataFrame, heads: int, d: int, scale: float | None = None) -> DataFrame:
    """(id, gq, gk, gv) of graph_transformer_aggr; ``nodes`` has q, k, v."""
    scale, w = 1 / math.sqrt(d) if scale is None else scale, heads * d
    full = nodes.join(grad, "id")
    cut = lambda m, k: m[:, k * w : (k + 1) * w].reshape(len(m), heads, d)
    dots = lambda a, b: np.einsum("nhd,nhd->nh", a, b)

    def sums(x: np.ndarray, y: np.ndarray, alpha: np.ndarray, ds: np.ndarray) -> tuple[np.ndarray, ...]:
        ds = (ds * scale)[:, :, None]
        by_source = np.concatenate([ds * cut(y, 0), alpha[:, :, None] * cut(y, 1)], 1)
        return by_source.reshape(len(x), 2 * w), (ds * cut(x, 0)).reshape(len(x), w), np.zeros((len(x), 0))

    src, dst, _ = _attended(edges, full, full, {"q": w, "v": w}, {"k": w, "g": w}, heads, lambda x, y: dots(cut(x, 0), cut(y, 0)) * scale, lambda x, y: dots(cut(x, 1), cut(y, 1)), sums, (2 * w, w, 0))
    return _cut(nodes, src, {"gq": w, "gv": w}).join(_cut(nodes, dst, {"gk": w}), "id").select("id", "gq", "gk", "gv")


def gatv2_backward(edges: DataFrame, nodes: DataFrame, grad: DataFrame, attn: list[list[float]], slope: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(id, gleft, gright) of gatv2_aggr and one row (gattn flat); ``nodes`` has left, right."""
    heads, d, a = len(attn), len(attn[0]), np.array(attn, float)
    w, full = heads * d, nodes.join(grad, "id")
    cut = lambda m, k: m[:, k * w : (k + 1) * w].reshape(len(m), heads, d)

    def score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        u = cut(x, 0) + cut(y, 0)
        return np.einsum("nhd,hd->nh", np.where(u > 0, u, u * slope), a)

    def sums(x: np.ndarray, y: np.ndarray, alpha: np.ndarray, ds: np.ndarray) -> tuple[np.ndarray, ...]:
        u, ds = cut(x, 0) + cut(y, 0), ds[:, :, None]
        du = ds * np.where(u > 0, a, a * slope)
        return tuple(m.reshape(len(x), w) for m in (alpha[:, :, None] * cut(y, 1) + du, du, ds * np.where(u > 0, u, u * slope)))

    right, left, total = _attended(edges, full, full, {"right": w}, {"left": w, "g": w}, heads, score, lambda x, y: np.einsum("nhd,nhd->nh", cut(x, 0), cut(y, 1)), sums, (w, w, w))
    return _cut(nodes, left, {"gleft": w}).join(_cut(nodes, right, {"gright": w}), "id").select("id", "gleft", "gright"), total.withColumnRenamed("v", "gattn")


def gat_backward(edges: DataFrame, nodes: DataFrame, grad: DataFrame, a_src: list[list[float]], a_dst: list[list[float]], slope: float = 0.2) -> DataFrame:
    """(id, gs, gd, gv) of gat_aggr; ``nodes`` has h.

    gs and gd are the gradients of the per-node scores a_src . h and a_dst . h by head, gv is that of h as a message: the whole gradient
    of h is gv + gs a_src + gd a_dst by head, those of a_src and a_dst are the sums over nodes of gs h and gd h.
    """
    heads, d = len(a_src), len(a_src[0])
    w = heads * d
    scored = gat_scores(gat_scores(nodes.select("id", "h").join(grad, "id"), "h", a_src, "_a"), "h", a_dst, "_b")
    u = lambda x, y: x[:, w:] + y[:, w : w + heads]

    def score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = u(x, y)
        return np.where(s > 0, s, s * slope)

    def sums(x: np.ndarray, y: np.ndarray, alpha: np.ndarray, ds: np.ndarray) -> tuple[np.ndarray, ...]:
        du = ds * np.where(u(x, y) > 0, 1.0, slope)
        messages = (alpha[:, :, None] * y[:, :w].reshape(len(y), heads, d)).reshape(len(y), w)
        return np.concatenate([du, messages], 1), du, np.zeros((len(x), 0))

    src, dst, _ = _attended(edges, scored, scored, {"h": w, "_a": heads}, {"g": w, "_b": heads}, heads, score, lambda x, y: np.einsum("nhd,nhd->nh", x[:, :w].reshape(len(x), heads, d), y[:, :w].reshape(len(y), heads, d)), sums, (heads + w, heads, 0))
    return _cut(nodes, src, {"gs": heads, "gv": w}).join(_cut(nodes, dst, {"gd": heads}), "id").select("id", "gs", "gd", "gv")


__all__ = ["edge_softmax", "edge_softmax_backward", "gat_backward", "gatv2_backward", "gt_backward", "minmax_backward", "spmm_backward"]
