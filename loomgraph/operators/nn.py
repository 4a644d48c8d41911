"""Dense layers on node tables: an Arrow-batch matrix product, element-wise functions as expressions, scoring and training.

Weights are small driver-side lists; node features never leave the executors.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packed
from ..functions import vectors as V
from ..functions.scratch import written
from ..session import ship_package
from . import adjoint, attention
from .aggregate import gcn_aggr, mean_aggr, random_walk_aggr, spmm, sum_aggr

Matrix = list[list[float]]


def linear(nodes: DataFrame, weight: Matrix, bias: list[float] | None = None, x: str = "x", out: str | None = None) -> DataFrame:
    """``nodes`` with x W^T + b, one matrix product for each Arrow batch."""
    ship_package(nodes.sparkSession)  # the product reads arrays with helpers of this package
    w, b = np.array(weight, float).reshape(len(weight), -1), np.array(bias if bias is not None else [0.0] * len(weight))

    @F.arrow_udf("array<double>")
    def product(rows: pa.Array) -> pa.Array:
        return V.lists_of(V.matrix_of(rows, w.shape[1]) @ w.T + b)

    return nodes.withColumn(out or x, product(F.col(x)))


ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "identity": lambda v: v,
    "relu": lambda v: F.greatest(v, F.lit(0.0)),
    "gelu": lambda v: 0.5 * v * (1 + V.erf(v / V.SQRT2)),
    "prelu": lambda v: V.leaky(v, 0.25),
    "elu": lambda v: F.when(v > 0, v).otherwise(F.exp(F.least(v, F.lit(0.0))) - 1),
    "tanh": F.tanh,
    "sigmoid": lambda v: 1 / (1 + F.exp(-v)),
    "silu": lambda v: v / (1 + F.exp(-v)),
}


def activation(nodes: DataFrame, name: str, x: str = "x") -> DataFrame:
    return nodes.withColumn(x, F.transform(x, ACTIVATIONS[name]))


def layer_norm(a: Column, gamma: list[float] | None = None, beta: list[float] | None = None, eps: float = 1e-5) -> Column:
    """(a - mean) / sqrt(biased variance + eps), slot-wise times gamma plus beta."""
    n = F.size(a)
    scale = lambda c: V.bound(F.sqrt(V.dot(c, c) / n + eps), lambda s: F.transform(c, lambda v: v / s))
    return affine(V.bound(V.total(a) / n, lambda mean: V.bound(F.transform(a, lambda v: v - mean), scale)), gamma, beta)


def rms_norm(a: Column, gamma: list[float] | None = None, eps: float = 1e-8) -> Column:
    return affine(V.bound(F.sqrt(V.dot(a, a) / F.size(a) + eps), lambda s: F.transform(a, lambda v: v / s)), gamma, None)


def affine(a: Column, gamma: list[float] | None, beta: list[float] | None) -> Column:
    if gamma is not None:
        a = F.zip_with(a, F.array(*map(F.lit, gamma)), lambda v, g: v * g)
    return V.add(a, F.array(*map(F.lit, beta))) if beta is not None else a


def batch_stats(nodes: DataFrame, width: int, x: str = "x") -> tuple[list[float], list[float]]:
    """Mean and biased variance of each slot over all rows: one aggregate, 2 width numbers."""
    row = nodes.agg(V.aggregated(F.avg, x, width).alias("m"), V.aggregated(F.var_pop, x, width).alias("v")).first()
    return [m or 0.0 for m in row["m"]], [1.0 if v is None else v for v in row["v"]]


def batch_norm(a: Column, mean: list[float], var: list[float], gamma: list[float] | None = None, beta: list[float] | None = None, eps: float = 1e-5) -> Column:
    scaled = F.zip_with(F.zip_with(a, F.array(*map(F.lit, mean)), lambda v, m: v - m), F.array(*[F.lit(1 / math.sqrt(v + eps)) for v in var]), lambda v, s: v * s)
    return affine(scaled, gamma, beta)


def normalize(nodes: DataFrame, kind: str, x: str = "x", width: int | None = None, stats: tuple[list[float], list[float]] | None = None) -> DataFrame:
    if kind == "none":
        return nodes
    if kind == "batch":
        mean, var = stats or batch_stats(nodes, width if width is not None else V.width_of(nodes, x), x)
        return nodes.withColumn(x, batch_norm(F.col(x), mean, var))
    return nodes.withColumn(x, {"layer": layer_norm, "rms": rms_norm}[kind](F.col(x)))


def qkv_split(nodes: DataFrame, weight: Matrix, names: tuple[str, ...] = ("q", "k", "v"), x: str = "x") -> DataFrame:
    """One projection with the stacked weights, cut into equal parts: (q, k, v) or (left, right)."""
    d = len(weight) // len(names)
    wide = linear(nodes, weight, None, x, "_w")
    return wide.withColumns({n: F.slice("_w", i * d + 1, d) for i, n in enumerate(names)}).drop("_w")


@dataclass
class Layer:
    """One residual block: projection, activation, convolution, normalisation; with the projection added if ``residual``."""

    weight: Matrix
    bias: list[float]
    act: str = "relu"
    conv: str = "gcn"
    norm: str = "none"
    residual: bool = True
    extra: dict = field(default_factory=dict)


def convolve(edges: DataFrame, nodes: DataFrame, conv: str, width: int, extra: dict) -> DataFrame:
    """(id, out) of one of the convolutions on x."""
    simple = {"sum": sum_aggr, "mean": mean_aggr, "gcn": gcn_aggr, "random_walk": random_walk_aggr}
    if conv in simple:
        return simple[conv](edges, nodes, width=width)
    if conv == "spmm":
        return spmm(edges, nodes, width=width, **extra)
    if conv == "gatv2":
        return attention.gatv2_aggr(edges, nodes.select("id", F.col("x").alias("left"), F.col("x").alias("right")), **extra)
    if conv == "graph_transformer":
        return attention.graph_transformer_aggr(edges, nodes.select("id", *[F.col("x").alias(c) for c in "qkv"]), width=width, **extra)
    raise ValueError(f"unknown convolution {conv}")


def residual_block(nodes: DataFrame, edges: DataFrame, layer: Layer) -> DataFrame:
    """nodes with the block's x; dropout is the identity when scoring."""
    width = len(layer.weight)
    h = written(activation(linear(nodes, layer.weight, layer.bias), layer.act).select("id", "x"))  # read by the convolution and the residual
    out = normalize(convolve(edges, h, layer.conv, width, layer.extra).withColumnRenamed("out", "x"), layer.norm, width=width)
    if layer.residual:
        out = out.join(h.select("id", F.col("x").alias("_h")), "id").select("id", V.add(F.col("x"), F.col("_h")).alias("x"))
    return nodes.drop("x").join(out, "id")


def encode(nodes: DataFrame, edges: DataFrame, layers: list[Layer]) -> DataFrame:
    """A stack of blocks; edges and the result of every block but the last are written to the shared folder, so plans don't grow with depth."""
    edges = written(edges)
    for i, layer in enumerate(layers, 1):
        nodes = residual_block(nodes, edges, layer)
        if i < len(layers):
            nodes = written(nodes)
    return nodes


def classify(nodes: DataFrame, weight: Matrix, bias: list[float] | None = None) -> DataFrame:
    """nodes with logits and pred, the first class of the largest logit."""
    return linear(nodes, weight, bias, "x", "logits").withColumn("pred", V.argmax(F.col("logits")))


def xent(y: str = "y", logits: str = "logits") -> Column:
    """Cross-entropy of a row."""
    lse = V.bound(F.array_max(logits), lambda top: top + F.ln(V.total(F.transform(logits, lambda v: F.exp(v - top)))))
    return lse - F.get(F.col(logits), F.col(y).cast("int"))


def softmax_xent(rows: DataFrame, y: str = "y", logits: str = "logits") -> DataFrame:
    """One row (loss): mean cross-entropy of labelled rows, 0 without any."""
    return rows.where(F.col(y).isNotNull()).agg(F.coalesce(F.avg(xent(y, logits)), F.lit(0.0)).alias("loss"))


def evaluate(nodes: DataFrame, edges: DataFrame, layers: list[Layer], head: tuple[Matrix, list[float]], split: str | None = None) -> DataFrame:
    """One row (loss, accuracy) of a stored model on a split."""
    scored = classify(encode(nodes, edges, layers), *head)
    rows = scored.where(F.col("split") == split) if split else scored
    hit = (F.col("y") == F.col("pred")).cast("double")
    return rows.where(F.col("y").isNotNull()).agg(F.coalesce(F.avg(xent()), F.lit(0.0)).alias("loss"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"))


def summed(parts: DataFrame, n: int) -> list[float]:
    """The slot-wise sum of the arrays v of n numbers, added up in Spark."""
    out = [0.0] * n
    for r in parts.select(F.posexplode("v").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[r["k"]] = r["x"]
    return out


@dataclass
class Fitted:
    weight: np.ndarray
    bias: np.ndarray
    history: list[dict]
    best_epoch: int

    def save(self, path: str, spark) -> None:
        """The weights as one JSON line in a folder."""
        spark.createDataFrame([(json.dumps({"weight": self.weight.tolist(), "bias": self.bias.tolist()}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def fit(nodes: DataFrame, edges: DataFrame, classes: int, hops: int = 2, conv: str = "gcn", epochs: int = 50, lr: float = 0.05, weight_decay: float = 0.0, check_every: int = 5, patience: int = 3, optimizer: str = "adamw") -> Fitted:
    """Full-batch softmax regression on features that ``hops`` convolutions have spread over the graph.

    The convolutions have no weights, so they run once; each epoch is one aggregate of the gradient, a sum over nodes of
    outer products made of batch partial sums, and one step on the driver.  Validation accuracy is checked every
    ``check_every`` epochs; ``patience`` checks without a better one end the training.
    """
    ship_package(nodes.sparkSession)
    width = V.width_of(nodes, "x")
    spread = nodes.select("id", "x")
    for _ in range(hops):
        spread = convolve(edges, spread, conv, width, {}).withColumnRenamed("out", "x")
    ready = written(spread.join(nodes.select("id", "y", "split"), "id").where("y is not null").select("x", F.col("y").cast("int").alias("y"), "split"))
    n = classes * (width + 1)

    def step(w: np.ndarray, split: str) -> tuple[np.ndarray, float, float]:
        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, loss, hits, count = np.zeros((classes, width + 1)), 0.0, 0, 0
            for b in batches:
                if not len(b):
                    continue
                x = np.column_stack([np.stack(b["x"].to_numpy()), np.ones(len(b))])
                y = b["y"].to_numpy()
                z = x @ w.T
                top = z.max(1, keepdims=True)
                p = np.exp(z - top)
                total = p.sum(1, keepdims=True)
                loss += float((np.log(total) + top)[:, 0].sum() - z[np.arange(len(b)), y].sum())
                hits += int((z.argmax(1) == y).sum())
                p /= total
                p[np.arange(len(b)), y] -= 1
                g += p.T @ x
                count += len(b)
            yield pd.DataFrame({"v": [[*g.ravel().tolist(), loss, float(hits), float(count)]]})

        parts = ready.where(F.col("split") == split).select("x", "y").mapInPandas(sums, "v array<double>")
        v = summed(parts, n + 3)
        count = max(v[-1], 1.0)
        return np.array(v[:n]).reshape(classes, width + 1) / count, v[-3] / count, v[-2] / count

    w = np.zeros((classes, width + 1))
    m, s = np.zeros_like(w), np.zeros_like(w)
    best, best_w, best_epoch, bad, history = -1.0, w.copy(), 0, 0, []
    for epoch in range(1, epochs + 1):
        g, loss, acc = step(w, "train")
        if optimizer == "sgd":
            w = w - lr * (g + weight_decay * w)
        else:
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            w = w - lr * (m / (1 - 0.9**epoch) / (np.sqrt(s / (1 - 0.999**epoch)) + 1e-8) + weight_decay * w)
        record = {"epoch": epoch, "loss": loss, "train_accuracy": acc, "val_accuracy": None}
        if epoch % check_every == 0:
            record["val_accuracy"] = step(w, "val")[2]
            if record["val_accuracy"] > best:
                best, best_w, best_epoch, bad = record["val_accuracy"], w.copy(), epoch, 0
            else:
                bad += 1
        history.append(record)
        if bad >= patience:
            break
    return Fitted(best_w[:, :-1], best_w[:, -1], history, best_epoch)


#: Derivatives of the activations, from the input of each.
SLOPES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "identity": np.ones_like,
    "relu": lambda z: (z > 0).astype(float),
    "prelu": lambda z: np.where(z > 0, 1.0, 0.25),
    "elu": lambda z: np.where(z > 0, 1.0, np.exp(np.minimum(z, 0))),
    "tanh": lambda z: 1 - np.tanh(z) ** 2,
    "sigmoid": lambda z: 1 / (1 + np.exp(-z)) * (1 - 1 / (1 + np.exp(-z))),
    "silu": lambda z: (1 + z * (1 - 1 / (1 + np.exp(-z)))) / (1 + np.exp(-z)),
    "gelu": lambda z: 0.5 * (1 + np.vectorize(math.erf, [float])(z / V.SQRT2)) + z * np.exp(-z * z / 2) / math.sqrt(2 * math.pi),
}
#: Weights of the convolutions that are matrix products.
NORMS = {"sum": "none", "mean": "right", "gcn": "both", "random_walk": "left"}


def convolve_backward(edges: DataFrame, h: DataFrame, grad: DataFrame, layer: Layer) -> DataFrame:
    """(id, g): gradient of the input (id, x) of a block's convolution from that of its result."""
    width = len(layer.weight)
    if layer.conv in NORMS or layer.conv == "spmm":
        extra = layer.extra if layer.conv == "spmm" else {"norm": NORMS[layer.conv]}
        return adjoint.spmm_backward(edges, h, grad, width=width, **extra).select("id", F.col("gx").alias("g"))
    if layer.conv == "gatv2":
        out, _ = adjoint.gatv2_backward(edges, h.select("id", F.col("x").alias("left"), F.col("x").alias("right")), grad, layer.extra["attn"], layer.extra.get("slope", 0.2))
        return out.select("id", V.add(F.col("gleft"), F.col("gright")).alias("g"))
    if layer.conv == "graph_transformer":
        heads = layer.extra.get("heads", 1)
        out = adjoint.gt_backward(edges, h.select("id", *[F.col("x").alias(c) for c in "qkv"]), grad, heads, width // heads, layer.extra.get("scale"))
        return out.select("id", V.add(V.add(F.col("gq"), F.col("gk")), F.col("gv")).alias("g"))
    raise ValueError(f"unknown convolution {layer.conv}")


def norm_backward(rows: DataFrame, kind: str) -> DataFrame:
    """(id, g) from rows (id, x, g) with the input of a normalisation by row."""
    if kind == "none":
        return rows.select("id", "g")
    if kind not in ("layer", "rms"):
        raise ValueError(f"no gradient through {kind} normalisation")

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, g = np.stack(b["x"].to_numpy()), np.stack(b["g"].to_numpy())
                centred = x - x.mean(1, keepdims=True) if kind == "layer" else x
                inverse = 1 / np.sqrt((centred * centred).mean(1, keepdims=True) + (1e-5 if kind == "layer" else 1e-8))
                y = centred * inverse
                out = inverse * (g - (g.mean(1, keepdims=True) if kind == "layer" else 0) - y * (g * y).mean(1, keepdims=True))
                yield pd.DataFrame({"id": b["id"], "g": list(out)})

    return rows.select("id", "x", "g").mapInPandas(back, "id long, g array<double>")


def dense_backward(rows: DataFrame, weight: np.ndarray, bias: np.ndarray, act: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(id, g) of the input of act(x W^T + b) from rows (id, x, g), and the gradients of W and b.

    The gradient of the weights is a sum over nodes of outer products: one vector a partition, added up by one aggregate.
    """
    n, m = weight.shape
    slope = SLOPES[act]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, m + 1))
        for b in batches:
            if len(b):
                x, g = np.stack(b["x"].to_numpy()), np.stack(b["g"].to_numpy())
                total += (g * slope(x @ weight.T + bias)).T @ np.column_stack([x, np.ones(len(x))])
        yield pd.DataFrame({"v": [total.ravel().tolist()]})

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, g = np.stack(b["x"].to_numpy()), np.stack(b["g"].to_numpy())
                yield pd.DataFrame({"id": b["id"], "g": list((g * slope(x @ weight.T + bias)) @ weight)})

    rows = rows.select("id", "x", "g")
    both = np.array(summed(rows.mapInPandas(sums, "v array<double>"), n * (m + 1))).reshape(n, m + 1)
    return rows.mapInPandas(back, "id long, g array<double>"), both[:, :-1], both[:, -1]


def _scale(kind: str | None, degree: str) -> Column:
    """What a sum is multiplied by: the degree to the power -1 or -1/2, degrees under 1 as 1."""
    d = F.greatest(F.coalesce(degree, F.lit(1)), F.lit(1)).cast("double")
    return {None: F.lit(1.0), "whole": 1 / d, "root": 1 / F.sqrt(d)}[kind]


#: How convolutions without weights split into a factor of the source's out-degree and one of the destination's in-degree.
FACTORS = {"sum": (None, None), "mean": (None, "whole"), "gcn": ("root", "root"), "random_walk": ("whole", None)}


class Hops:
    """Convolutions without weights and their adjoints as passes over packed edges; node tables of the passes are (id, a column of arrays)."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, width: int):
        self.n = nodes.count()
        self.edges = packed.packed(edges, self.n, width)
        found = packed.degrees(self.edges, self.n, nodes)
        self.nodes = written(nodes.select("id").join(found.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("id", "outs", "ins"))

    def _pass(self, rows: DataFrame, x: str, conv: str, width: int, back: bool) -> DataFrame:
        at_src, at_dst = FACTORS[conv]
        (first, by), (last, then) = ((at_dst, "ins"), (at_src, "outs")) if back else ((at_src, "outs"), (at_dst, "ins"))
        rows = rows.select("id", F.col(x).alias("v"))
        given = rows.join(self.nodes, "id").select("id", V.scaled(F.col("v"), _scale(first, by)).alias("v")) if first else rows
        found = packed.sums(self.edges, self.n, given, self.nodes, width, back)
        every = self.nodes.join(found, "id", "left")
        return every.select("id", F.coalesce(V.scaled(F.col("v"), _scale(last, then)) if last else F.col("v"), V.zeros(width)).alias("v"))

    def forward(self, rows: DataFrame, conv: str, width: int) -> DataFrame:
        """(id, out) of the convolution of x."""
        return self._pass(rows, "x", conv, width, False).withColumnRenamed("v", "out")

    def backward(self, grad: DataFrame, conv: str, width: int) -> DataFrame:
        """(id, g): the gradient of x from that of the result."""
        return self._pass(grad, "g", conv, width, True).withColumnRenamed("v", "g")


def gradients(nodes: DataFrame, edges: DataFrame, layers: list[Layer], head: tuple[Matrix, list[float]], split: str = "train") -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
    """Mean cross-entropy of a split's labelled rows, and its gradients by (weight, bias) of each block and of the head.

    Forward, every block's input, hidden values and convolution are written once; backward, one adjoint convolution and one pass of
    dense work a block.  Convolutions without weights go over edges that are packed once.  Nothing but weights and their gradients reaches
    the driver.
    """
    edges = edges if all(x.conv in FACTORS for x in layers) else written(edges)
    state, x = [], written(nodes.select("id", "x"))
    simple = [len(layer.weight) for layer in layers if layer.conv in FACTORS]
    hops = Hops(edges, x, max(simple)) if simple else None
    for layer in layers:
        width = len(layer.weight)
        h = written(activation(linear(x, layer.weight, layer.bias), layer.act))
        found = hops.forward(h, layer.conv, width) if layer.conv in FACTORS else convolve(edges, h, layer.conv, width, layer.extra)
        c = written(found.withColumnRenamed("out", "x"))
        out = normalize(c, layer.norm)
        if layer.residual:
            out = out.join(h.select("id", F.col("x").alias("_h")), "id").select("id", V.add(F.col("x"), F.col("_h")).alias("x"))
        state.append((layer, x, h, c))
        x = written(out) if out is not c else c
    scored = classify(x.join(nodes.select("id", "y", "split"), "id"), *head)
    rows = written(scored.where(F.col("split") == split).where(F.col("y").isNotNull()).select("id", "x", F.col("y").cast("int").alias("y"), "logits"))
    loss, n = rows.agg(F.avg(xent()), F.count("*")).first()
    off = F.transform(V.softmax(F.col("logits")), lambda p, i: (p - (i == F.col("y")).cast("double")) / F.lit(float(max(n, 1))))
    g, *of_head = dense_backward(rows.withColumn("g", off), np.array(head[0], float), np.array(head[1], float), "identity")
    found = [tuple(of_head)]
    grad = written(x.select("id").join(g, "id", "left").select("id", F.coalesce("g", V.zeros(len(head[0][0]))).alias("g")))
    for k, (layer, before, h, c) in reversed(list(enumerate(state))):
        back = grad if layer.norm == "none" else written(norm_backward(c.join(grad, "id"), layer.norm))
        inner = hops.backward(back, layer.conv, len(layer.weight)) if layer.conv in FACTORS else convolve_backward(edges, h, back, layer)
        if layer.residual:
            inner = inner.join(grad.select("id", F.col("g").alias("_g")), "id").select("id", V.add(F.col("g"), F.col("_g")).alias("g"))
        g, *of_layer = dense_backward(written(before.join(inner, "id")), np.array(layer.weight, float), np.array(layer.bias, float), layer.act)
        found.append(tuple(of_layer))
        if k:  # nothing stands in front of the first block
            grad = written(g)
    return float(loss or 0.0), found[::-1]


@dataclass
class Trained:
    layers: list[Layer]
    head: tuple[Matrix, list[float]]
    history: list[dict]
    best_epoch: int


def train(nodes: DataFrame, edges: DataFrame, layers: list[Layer], head: tuple[Matrix, list[float]], epochs: int = 20, lr: float = 0.05, weight_decay: float = 0.0, check_every: int = 1, patience: int = 3, optimizer: str = "adamw") -> Trained:
    """Full-batch training of all weights of a stack of blocks and its head, from the weights given.

    Every ``check_every`` epochs the validation accuracy is taken; the weights of the best one are returned, and ``patience`` checks
    without a better one end the training.
    """
    weights = [np.array(a, float) for x in layers for a in (x.weight, x.bias)] + [np.array(a, float) for a in head]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def model(ws: list[np.ndarray]) -> tuple[list[Layer], tuple[Matrix, list[float]]]:
        pairs = [(ws[i].tolist(), ws[i + 1].tolist()) for i in range(0, len(ws), 2)]
        return [replace(x, weight=w, bias=b) for x, (w, b) in zip(layers, pairs[:-1], strict=True)], pairs[-1]

    best, best_weights, best_epoch, bad, history = -1.0, weights, 0, 0, []
    for epoch in range(1, epochs + 1):
        loss, found = gradients(nodes, edges, *model(weights))
        for i, g in enumerate(x for pair in found for x in pair):
            decay = weight_decay if weights[i].ndim > 1 else 0.0  # biases don't decay
            if optimizer == "sgd":
                weights[i] = weights[i] - lr * (g + decay * weights[i])
            else:
                first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - lr * (first[i] / (1 - 0.9**epoch) / (np.sqrt(second[i] / (1 - 0.999**epoch)) + 1e-8) + decay * weights[i])
        record = {"epoch": epoch, "loss": loss, "val_accuracy": None}
        if epoch % check_every == 0:
            record["val_accuracy"] = evaluate(nodes, edges, *model(weights), "val").first()["accuracy"]
            if record["val_accuracy"] > best:
                best, best_weights, best_epoch, bad = record["val_accuracy"], list(weights), epoch, 0
            else:
                bad += 1
        history.append(record)
        if bad >= patience:
            break
    return Trained(*model(best_weights if best_epoch else weights), history, best_epoch)
