"""Full-batch training of stacks of graph blocks with all their weights: projections and attention vectors, affine and batch
normalisation, learned PReLU slopes, dropout; runs that can be stopped and resumed.

A block is act(x W^T + b), a convolution, a normalisation, dropout, and the projection added again.  Node tables never leave the executors: an
epoch is a chain of gathers and groupings for the convolutions and of one Arrow pass a block for what belongs to single nodes, whose weight
gradients are summed to one vector a task and added up in Spark.  The tables of an epoch lie in one scratch folder that goes when it ends.

Attention blocks project their input first: ``graph_transformer`` (queries, keys and values with bias, of the layer-normed input),
``gatv2`` (left, right, each head as wide as the block, and an outer projection), ``gat`` (one projection, two attention vectors a head).
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.scratch import Scratch, delete, scratch_scope
from ..session import ship_package
from . import adjoint, attention, nn

Arrays = dict[str, np.ndarray]
EPS = {"layer": 1e-5, "batch": 1e-5, "rms": 1e-8}
#: Share of a new batch statistic in the running one.
MOMENTUM = 0.1
PLAIN = ("sum", "mean", "gcn", "random_walk", "spmm")


@dataclass(frozen=True)
class Block:
    width: int
    act: str = "relu"
    conv: str = "gcn"
    heads: int = 1
    norm: str = "none"
    dropout: float = 0.0
    residual: bool = True
    slope: float = 0.2
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.conv not in (*PLAIN, "gat", "gatv2", "graph_transformer"):
            raise ValueError(f"unknown convolution {self.conv}")
        if self.norm not in ("none", *EPS) or self.act not in nn.ACTIVATIONS or not 0 <= self.dropout < 1:
            raise ValueError(f"no such block: {self}")
        if self.conv in ("gat", "graph_transformer") and self.width % self.heads:
            raise ValueError("the width must be a multiple of the heads")

    @property
    def head(self) -> int:
        """Slots of one head."""
        return self.width if self.conv == "gatv2" else self.width // self.heads

    @property
    def projections(self) -> dict[str, bool]:
        """Projections before the convolution, and whether they have a bias."""
        return {"graph_transformer": {"q": True, "k": True, "v": True}, "gatv2": {"left": False, "right": False}, "gat": {"p": False}}.get(self.conv, {})

    def shapes(self, inputs: int) -> dict[str, tuple[int, ...]]:
        w, wide = self.width, self.heads * self.head
        out: dict[str, tuple[int, ...]] = {"weight": (w, inputs), "bias": (w,)}
        if self.act == "prelu":
            out["alpha"] = (w,)
        for p, has_bias in self.projections.items():
            out[f"{p}.weight"] = (wide, w)
            if has_bias:
                out[f"{p}.bias"] = (wide,)
        if self.conv == "gatv2":
            out |= {"attn": (self.heads, w), "out.weight": (w, wide)}
        if self.conv == "gat":
            out |= {"a_src": (self.heads, self.head), "a_dst": (self.heads, self.head)}
        if self.norm != "none":
            out["gamma"] = (w,)
        if self.norm in ("layer", "batch"):
            out["beta"] = (w,)
        return out


@dataclass
class Model:
    """Blocks, their weights by name ("0.weight", ..., "head.weight"), and running statistics of batch normalisation ("0.mean", "0.var")."""

    blocks: list[Block]
    weights: Arrays
    state: Arrays

    def of(self, k: int) -> Arrays:
        return {n.split(".", 1)[1]: w for n, w in self.weights.items() if n.startswith(f"{k}.")}


def model_shapes(blocks: list[Block], inputs: int, classes: int) -> dict[str, tuple[int, ...]]:
    out = {}
    for k, b in enumerate(blocks):
        out |= {f"{k}.{n}": s for n, s in b.shapes(inputs).items()}
        inputs = b.width
    return out | {"head.weight": (classes, inputs), "head.bias": (classes,)}


def new_model(blocks: list[Block], inputs: int, classes: int, seed: int = 0) -> Model:
    """Weights drawn evenly within the root of 6 over both widths, slopes of 0.25, gammas of one, all other vectors of zero."""
    r, weights = np.random.default_rng(seed), {}
    for name, shape in model_shapes(blocks, inputs, classes).items():
        last = name.rsplit(".", 1)[-1]
        if len(shape) > 1:
            bound = math.sqrt(6 / sum(shape))
            weights[name] = r.uniform(-bound, bound, shape)
        else:
            weights[name] = np.full(shape, {"alpha": 0.25, "gamma": 1.0}.get(last, 0.0))
    state = {}
    for k, b in enumerate(blocks):
        if b.norm == "batch":
            state |= {f"{k}.mean": np.zeros(b.width), f"{k}.var": np.ones(b.width)}
    return Model(blocks, weights, state)


# ---- what belongs to single nodes: functions on the rows of a batch -------------------------------------------------------------------


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


CURVES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "identity": lambda z: z,
    "relu": lambda z: np.maximum(z, 0),
    "elu": lambda z: np.where(z > 0, z, np.expm1(np.minimum(z, 0))),
    "tanh": np.tanh,
    "sigmoid": sigmoid,
    "silu": lambda z: z * sigmoid(z),
    "gelu": lambda z: 0.5 * z * (1 + np.vectorize(math.erf, [float])(z / V.SQRT2)),
}


def curve(block: Block, w: Arrays, z: np.ndarray) -> np.ndarray:
    return np.where(z > 0, z, z * w["alpha"]) if block.act == "prelu" else CURVES[block.act](z)


def steepness(block: Block, w: Arrays, z: np.ndarray) -> np.ndarray:
    return np.where(z > 0, 1.0, w["alpha"]) if block.act == "prelu" else nn.SLOPES[block.act](z)


def standard(x: np.ndarray, kind: str, stats: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Normalised rows and the factor that they were multiplied by."""
    if kind == "batch":
        factor = 1 / np.sqrt(stats[1] + EPS[kind])
        return (x - stats[0]) * factor, factor
    centred = x - x.mean(1, keepdims=True) if kind == "layer" else x
    factor = 1 / np.sqrt((centred * centred).mean(1, keepdims=True) + EPS[kind])
    return centred * factor, factor


def standard_back(y: np.ndarray, factor: np.ndarray, g: np.ndarray, kind: str, means: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Gradient of the input from that of the normalised rows y; for batches ``means`` are those of g and of g y over all nodes."""
    if kind == "batch":
        return factor * (g - means[0] - y * means[1])
    return factor * (g - (g.mean(1, keepdims=True) if kind == "layer" else 0) - y * (g * y).mean(1, keepdims=True))


def kept(ids: np.ndarray, width: int, share: float, key: int) -> np.ndarray:
    """Dropout's factors: a function of node, slot and key alone, so that forward, backward and a task that runs again agree."""
    u = lambda x: np.uint64(x % (1 << 64))
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64)[:, None] * u(0x9E3779B97F4A7C15) + np.arange(1, width + 1, dtype=np.uint64) * u(0xC2B2AE3D27D4EB4F) + u(key)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * u(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) * 2.0**-53 >= share) / (1 - share)


def dropout_key(seed: int, epoch: int, block: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{epoch}:{block}".encode()).digest()[:8])


def projected(block: Block, w: Arrays, h: np.ndarray) -> Arrays:
    p = standard(h, "layer", None)[0] if block.conv == "graph_transformer" else h
    return {n: p @ w[f"{n}.weight"].T + (w[f"{n}.bias"] if has_bias else 0) for n, has_bias in block.projections.items()}


# ---- passes over node tables ----------------------------------------------------------------------------------------------------------


def passed(scratch: Scratch, rows: DataFrame, ins: dict[str, int], step: Callable, outs: dict[str, int], sums: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(id, outs) of one Arrow pass over (id, ins), and the sum over all rows of a vector of ``sums`` numbers.

    Widths of arrays; 0 is a number column.  ``step`` takes ids and a dict of matrices and gives a dict of matrices and a vector.  Each task
    adds one row with its part of the sum to what it writes, so that both come from one pass.
    """
    names, list_type = list(ins), pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sums)
        for b in batches:
            if b.num_rows:
                values = {c: b.column(c).to_numpy(zero_copy_only=False) if ins[c] == 0 else V.matrix_of(b.column(c), ins[c]) for c in names}
                found, part = step(b.column("id").to_numpy(zero_copy_only=False), values)
                total += part
                yield pa.RecordBatch.from_arrays([b.column("id"), *[V.lists_of(found[c]) for c in outs], pa.nulls(b.num_rows, list_type)], names=["id", *outs, "_sums"])
        if sums:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *[pa.nulls(1, list_type) for _ in outs], V.lists_of(total[None])], names=["id", *outs, "_sums"])

    table = scratch.write(rows.select("id", *names).mapInArrow(run, ", ".join(["id long", *[f"`{c}` array<double>" for c in outs], "_sums array<double>"])))
    vector = np.array(nn.summed(table.where("_sums is not null").select(F.col("_sums").alias("v")), sums)) if sums else np.zeros(0)
    return table.where("_sums is null").drop("_sums"), vector


def cut(vector: np.ndarray, shapes: dict[str, tuple[int, ...]]) -> Arrays:
    out, at = {}, 0
    for name, shape in shapes.items():
        n = math.prod(shape)
        out[name], at = vector[at : at + n].reshape(shape), at + n
    return out


def joined(parts: dict[str, np.ndarray], shapes: dict[str, tuple[int, ...]]) -> np.ndarray:
    return np.concatenate([parts[n].ravel() for n in shapes]) if shapes else np.zeros(0)


@dataclass
class Step:
    """What a block's forward pass leaves for the way back."""

    x: DataFrame
    inputs: int
    h: DataFrame
    o: DataFrame
    stats: tuple[np.ndarray, np.ndarray] | None
    key: int | None


def forward(scratch: Scratch, edges: DataFrame, x: DataFrame, inputs: int, block: Block, w: Arrays, running: tuple[np.ndarray, np.ndarray] | None, key: int | None) -> tuple[DataFrame, Step]:
    """(id, x) behind a block.  ``running`` statistics are used when scoring; without them the table's own.  ``key`` turns dropout on."""
    width, wide = block.width, block.heads * block.head

    def dense(_: np.ndarray, m: Arrays):
        h = curve(block, w, m["x"] @ w["weight"].T + w["bias"])
        return {"h": h, **projected(block, w, h)}, 0.0

    h, _ = passed(scratch, x, {"x": inputs}, dense, {"h": width, **dict.fromkeys(block.projections, wide)})
    if block.conv == "graph_transformer":
        found = attention.graph_transformer_aggr(edges, h, block.heads, width=width)
    elif block.conv == "gatv2":
        found = attention.gatv2_aggr(edges, h, w["attn"].tolist(), slope=block.slope)
    elif block.conv == "gat":
        found = attention.gat_aggr(edges, h, w["a_src"].tolist(), w["a_dst"].tolist(), "p", block.slope)
    else:
        found = nn.convolve(edges, h.select("id", F.col("h").alias("x")), block.conv, width, block.extra)
    if block.conv == "gatv2":
        o, _ = passed(scratch, found.withColumnRenamed("out", "c"), {"c": wide}, lambda _, m: ({"c": m["c"], "o": m["c"] @ w["out.weight"].T}, 0.0), {"c": wide, "o": width})
    else:
        o = scratch.write(found.select("id", F.col("out").alias("o")))
    stats = running
    if block.norm == "batch" and stats is None:
        stats = tuple(map(np.array, nn.batch_stats(o, width, "o")))

    def behind(ids: np.ndarray, m: Arrays):
        y = m["o"]
        if block.norm != "none":
            y = standard(y, block.norm, stats)[0] * w["gamma"] + w.get("beta", 0.0)
        if block.dropout and key is not None:
            y = y * kept(ids, width, block.dropout, key)
        return {"x": y + m["h"] if block.residual else y}, 0.0

    out, _ = passed(scratch, o.join(h.select("id", "h"), "id"), {"o": width, "h": width}, behind, {"x": width})
    return out, Step(x, inputs, h, o, stats, key)


def backward(scratch: Scratch, edges: DataFrame, g: DataFrame, n: int, block: Block, w: Arrays, s: Step) -> tuple[DataFrame, Arrays]:
    """(id, g) in front of a block from (id, g) behind it, and the gradients of its weights; n nodes in all."""
    width, wide = block.width, block.heads * block.head
    shapes, stats, key = block.shapes(s.inputs), s.stats, s.key  # steps must not hold tables

    def through_dropout(ids: np.ndarray, g: np.ndarray) -> np.ndarray:
        return g * kept(ids, width, block.dropout, key) if block.dropout and key is not None else g

    rows, means, grads = s.o.join(g, "id"), None, {}
    late = {k: v for k, v in shapes.items() if k in ("gamma", "beta", "out.weight")}
    if block.norm == "batch":  # the statistics depend on every node: two sums come first

        def totals(ids: np.ndarray, m: Arrays):
            gy = through_dropout(ids, m["g"]) * w["gamma"]
            return {}, np.concatenate([gy.sum(0), (gy * standard(m["o"], "batch", stats)[0]).sum(0)])

        means = tuple(np.split(passed(scratch, rows, {"o": width, "g": width}, totals, {}, 2 * width)[1] / n, 2))

    def to_convolution(ids: np.ndarray, m: Arrays):
        go, parts = through_dropout(ids, m["g"]), {}
        if block.norm != "none":
            y, factor = standard(m["o"], block.norm, stats)
            parts |= {"gamma": (go * y).sum(0), "beta": go.sum(0)}
            go = standard_back(y, factor, go * w["gamma"], block.norm, means)
        if block.conv == "gatv2":
            parts["out.weight"] = go.T @ m["c"]
            go = go @ w["out.weight"]
        return {"g": go}, joined(parts, late)

    ins = {"o": width, "g": width, **({"c": wide} if block.conv == "gatv2" else {})}
    gc, found = passed(scratch, rows, ins, to_convolution, {"g": wide if block.conv == "gatv2" else width}, sum(map(math.prod, late.values())))
    grads |= cut(found, late)
    if block.conv == "graph_transformer":
        back, cols = adjoint.gt_backward(edges, s.h.select("id", "q", "k", "v"), gc, block.heads, block.head), {"gq": width, "gk": width, "gv": width}
    elif block.conv == "gatv2":
        back, attn = adjoint.gatv2_backward(edges, s.h.select("id", "left", "right"), gc, w["attn"].tolist(), block.slope)
        grads["attn"], cols = np.array(attn.first()["gattn"]).reshape(w["attn"].shape), {"gleft": wide, "gright": wide}
    elif block.conv == "gat":
        back, cols = adjoint.gat_backward(edges, s.h.select("id", F.col("p").alias("h")), gc, w["a_src"].tolist(), w["a_dst"].tolist(), block.slope), {"gs": block.heads, "gd": block.heads, "gv": width}
    else:
        extra = block.extra if block.conv == "spmm" else {"norm": nn.NORMS[block.conv]}
        back, cols = adjoint.spmm_backward(edges, s.h.select("id"), gc, width=width, **extra).select("id", "gx"), {"gx": width}
    rest = {k: v for k, v in shapes.items() if k not in late and k != "attn"}

    def to_input(_: np.ndarray, m: Arrays):
        z = m["x"] @ w["weight"].T + w["bias"]
        h, parts = curve(block, w, z), {}
        gh = m["g"] if block.residual else np.zeros_like(h)
        if block.projections:
            source, factor = standard(h, "layer", None) if block.conv == "graph_transformer" else (h, None)
            if block.conv == "gat":
                p = projected(block, w, h)["p"].reshape(len(h), block.heads, block.head)
                gp = m["gv"].reshape(p.shape) + m["gs"][:, :, None] * w["a_src"] + m["gd"][:, :, None] * w["a_dst"]
                parts |= {"a_src": np.einsum("nh,nhd->hd", m["gs"], p), "a_dst": np.einsum("nh,nhd->hd", m["gd"], p)}
                of = {"p": gp.reshape(len(h), width)}
            else:
                of = {name: m[f"g{name}"] for name in block.projections}
            gs = 0
            for name, gp in of.items():
                parts |= {f"{name}.weight": gp.T @ source, f"{name}.bias": gp.sum(0)}
                gs = gs + gp @ w[f"{name}.weight"]
            gh = gh + (standard_back(source, factor, gs, "layer", None) if block.conv == "graph_transformer" else gs)
        else:
            gh = gh + m["gx"]
        if block.act == "prelu":
            parts["alpha"] = (gh * np.where(z > 0, 0.0, z)).sum(0)
        gz = gh * steepness(block, w, z)
        parts |= {"weight": gz.T @ m["x"], "bias": gz.sum(0)}
        return {"g": gz @ w["weight"]}, joined(parts, rest)

    rows = s.x.join(back, "id").join(g, "id") if block.residual else s.x.join(back, "id")
    out, found = passed(scratch, rows, {"x": s.inputs, **cols, **({"g": width} if block.residual else {})}, to_input, {"g": s.inputs}, sum(map(math.prod, rest.values())))
    return out, grads | cut(found, rest)


def encoded(scratch: Scratch, edges: DataFrame, nodes: DataFrame, model: Model, inputs: int, seed: int | None, epoch: int) -> tuple[DataFrame, list[Step]]:
    """(id, x) behind all blocks; with a seed as in training (own statistics, dropout), without one as for scoring."""
    x, steps = nodes.select("id", "x"), []
    for k, block in enumerate(model.blocks):
        running = (model.state[f"{k}.mean"], model.state[f"{k}.var"]) if seed is None and block.norm == "batch" else None
        x, step = forward(scratch, edges, x, inputs, block, model.of(k), running, None if seed is None else dropout_key(seed, epoch, k))
        steps.append(step)
        inputs = block.width
    return x, steps


def losses(scratch: Scratch, x: DataFrame, targets: DataFrame, model: Model, n: int) -> tuple[DataFrame, Arrays, float, float]:
    """(id, g) behind the blocks, the head's gradients, mean loss and accuracy; ``targets`` (id, target), -1 for nodes that don't count."""
    w, b = model.weights["head.weight"], model.weights["head.bias"]
    shapes = {"head.weight": w.shape, "head.bias": b.shape}

    def step(_: np.ndarray, m: Arrays):
        z = m["x"] @ w.T + b
        top = z.max(1, keepdims=True)
        p = np.exp(z - top)
        total = p.sum(1, keepdims=True)
        there = m["target"] >= 0
        rows, y = np.flatnonzero(there), m["target"][there].astype(int)
        loss = (np.log(total) + top)[rows, 0].sum() - z[rows, y].sum()
        g = p / total
        g[rows, y] -= 1
        g[~there] = 0
        g /= n
        return {"g": g @ w}, np.concatenate([(g.T @ m["x"]).ravel(), g.sum(0), [loss / n, (z[rows].argmax(1) == y).sum() / n]])

    found, sums = passed(scratch, x.join(targets, "id"), {"x": w.shape[1], "target": 0}, step, {"g": w.shape[1]}, w.size + b.size + 2)
    return found, cut(sums, shapes), float(sums[-2]), float(sums[-1])


def targets_of(nodes: DataFrame, split: str | None) -> DataFrame:
    counts = F.col("y").isNotNull() & (F.col("split").eqNullSafe(split) if split else F.lit(True))
    return nodes.select("id", F.when(counts, F.col("y").cast("long")).otherwise(F.lit(-1).cast("long")).alias("target"))


def counted(targets: DataFrame) -> int:
    return max(1, targets.where("target >= 0").count())


def gradients(nodes: DataFrame, edges: DataFrame, model: Model, split: str = "train", seed: int = 0, epoch: int = 1) -> tuple[float, Arrays, Arrays]:
    """Mean cross-entropy of a split's labelled nodes in training, its gradient by every weight, and the running statistics after this pass.

    ``nodes`` has id, x, y and split.  All tables are gone when it returns.
    """
    spark = ship_package(nodes.sparkSession)
    inputs = model.weights["0.weight"].shape[1] if model.blocks else model.weights["head.weight"].shape[1]
    with scratch_scope(spark) as scratch:
        targets = scratch.write(targets_of(nodes, split))
        total = targets.count()
        x, steps = encoded(scratch, edges, nodes, model, inputs, seed, epoch)
        g, grads, loss, _ = losses(scratch, x, targets, model, counted(targets))
        state = dict(model.state)
        for k in reversed(range(len(steps))):
            if model.blocks[k].norm == "batch":
                mean, var = steps[k].stats
                unbiased = var * total / max(1, total - 1)
                state |= {f"{k}.mean": (1 - MOMENTUM) * state[f"{k}.mean"] + MOMENTUM * mean, f"{k}.var": (1 - MOMENTUM) * state[f"{k}.var"] + MOMENTUM * unbiased}
            g, found = backward(scratch, edges, g, total, model.blocks[k], model.of(k), steps[k])
            grads |= {f"{k}.{name}": v for name, v in found.items()}
    return loss, {name: grads[name] for name in model.weights}, state


def evaluate(nodes: DataFrame, edges: DataFrame, model: Model, split: str | None = None) -> tuple[float, float]:
    """Mean loss and accuracy of a split when scoring: running statistics, no dropout."""
    spark = ship_package(nodes.sparkSession)
    inputs = model.weights["0.weight"].shape[1] if model.blocks else model.weights["head.weight"].shape[1]
    with scratch_scope(spark) as scratch:
        targets = scratch.write(targets_of(nodes, split))
        x, _ = encoded(scratch, edges, nodes, model, inputs, None, 0)
        return losses(scratch, x, targets, model, counted(targets))[2:]


def score(nodes: DataFrame, edges: DataFrame, model: Model) -> DataFrame:
    """``nodes`` with logits and pred; intermediate tables stay until the session's scratch folder is cleared."""
    scratch = Scratch(ship_package(nodes.sparkSession))
    inputs = model.weights["0.weight"].shape[1] if model.blocks else model.weights["head.weight"].shape[1]
    x, _ = encoded(scratch, edges, nodes, model, inputs, None, 0)
    return nodes.drop("x").join(nn.classify(x, model.weights["head.weight"].tolist(), model.weights["head.bias"].tolist()), "id")


# ---- runs -----------------------------------------------------------------------------------------------------------------------------


@dataclass
class Run:
    """Everything a run needs to go on: the model now and at its best, the optimiser's moments and what happened so far."""

    model: Model
    best: Model
    moments: tuple[Arrays, Arrays]
    history: list[dict]
    epoch: int = 0
    best_score: float = -1.0
    best_epoch: int = 0
    bad: int = 0

    def to_json(self) -> str:
        lists = lambda a: {k: v.tolist() for k, v in a.items()}
        of = lambda m: {"weights": lists(m.weights), "state": lists(m.state)}
        more = {k: getattr(self, k) for k in ("history", "epoch", "best_score", "best_epoch", "bad")}
        return json.dumps({"blocks": [asdict(b) for b in self.model.blocks], "model": of(self.model), "best": of(self.best), "moments": [lists(m) for m in self.moments], **more})

    @classmethod
    def from_json(cls, text: str) -> Run:
        d = json.loads(text)
        arrays = lambda a: {k: np.array(v, float) for k, v in a.items()}
        blocks = [Block(**b) for b in d["blocks"]]
        model, best = (Model(blocks, arrays(d[k]["weights"]), arrays(d[k]["state"])) for k in ("model", "best"))
        return cls(model, best, tuple(arrays(m) for m in d["moments"]), d["history"], d["epoch"], d["best_score"], d["best_epoch"], d["bad"])


class Store:
    """Published states of a run below one folder.  A state is written beside and then renamed, so a reader finds it whole or not at all; the
    ``keep`` newest stay."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def epochs(self) -> list[int]:
        if not self.fs.exists(self.path(self.root)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.root))]
        return sorted(int(n[6:]) for n in names if n.startswith("epoch-") and n[6:].isdigit() and self.fs.exists(self.path(f"{self.root}/{n}/_SUCCESS")))

    def publish(self, run: Run) -> None:
        name, beside = f"{self.root}/epoch-{run.epoch:09d}", f"{self.root}/unfinished-{run.epoch:09d}"
        self.spark.createDataFrame([(run.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(beside)
        delete(self.spark, name)
        if not self.fs.rename(self.path(beside), self.path(name)):
            raise OSError(f"{name} could not be published")
        for old in self.epochs()[: -self.keep]:
            delete(self.spark, f"{self.root}/epoch-{old:09d}")

    def latest(self) -> Run | None:
        found = self.epochs()
        return Run.from_json(self.spark.read.text(f"{self.root}/epoch-{found[-1]:09d}").first()[0]) if found else None


def stepped(run: Run, grads: Arrays, lr: float, decay: float, optimizer: str) -> None:
    """One step of SGD or AdamW; vectors don't decay."""
    t = run.epoch
    for name, g in grads.items():
        w = run.model.weights[name]
        d = decay if w.ndim > 1 else 0.0
        if optimizer == "sgd":
            run.model.weights[name] = w - lr * (g + d * w)
            continue
        first, second = run.moments
        first[name], second[name] = 0.9 * first[name] + 0.1 * g, 0.999 * second[name] + 0.001 * g * g
        run.model.weights[name] = w - lr * (first[name] / (1 - 0.9**t) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8) + d * w)


def train(nodes: DataFrame, edges: DataFrame, model: Model, epochs: int = 20, lr: float = 0.05, weight_decay: float = 0.0, check_every: int = 1, patience: int = 3, optimizer: str = "adamw", seed: int = 0, store: str | None = None, publish_every: int = 1) -> Run:
    """Full-batch epochs from the given model, or from the last state published in ``store``.

    Every ``check_every`` epochs the validation accuracy is taken as for scoring; ``patience`` checks without a better one end the run.
    A run that is stopped and called again with the same arguments goes on and ends as if it had not been stopped.
    """
    if optimizer not in ("sgd", "adamw"):
        raise ValueError(f"unknown optimizer {optimizer}")
    kept_states = Store(nodes.sparkSession, store) if store else None
    run = kept_states.latest() if kept_states else None
    if run is None:
        zeros = lambda: {k: np.zeros_like(v) for k, v in model.weights.items()}
        run = Run(replace(model, weights=dict(model.weights), state=dict(model.state)), model, (zeros(), zeros()), [])
    elif run.model.blocks != model.blocks or {k: v.shape for k, v in run.model.weights.items()} != {k: v.shape for k, v in model.weights.items()}:
        raise ValueError(f"{store} holds a run of another model")
    with scratch_scope(nodes.sparkSession) as scratch:
        edges = scratch.write(edges)
        nodes = scratch.write(nodes.select("id", "x", "y", "split"))
        while run.epoch < epochs and run.bad < patience:
            run.epoch += 1
            loss, grads, run.model.state = gradients(nodes, edges, run.model, "train", seed, run.epoch)
            stepped(run, grads, lr, weight_decay, optimizer)
            record = {"epoch": run.epoch, "loss": loss, "val_loss": None, "val_accuracy": None}
            if run.epoch % check_every == 0:
                record["val_loss"], record["val_accuracy"] = evaluate(nodes, edges, run.model, "val")
                if record["val_accuracy"] > run.best_score:
                    run.best_score, run.best_epoch, run.bad = record["val_accuracy"], run.epoch, 0
                    run.best = replace(run.model, weights=dict(run.model.weights), state=dict(run.model.state))
                else:
                    run.bad += 1
            run.history.append(record)
            if kept_states and (run.epoch % publish_every == 0 or run.epoch == epochs or run.bad >= patience):
                kept_states.publish(run)
    if not run.best_epoch:
        run.best = run.model
    return run
