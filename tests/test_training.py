"""Training of whole models against a dense model in numpy: losses, and every gradient against finite differences."""

import os

import numpy as np
import pytest

from loomgraph.functions.scratch import shared_dir
from loomgraph.operators import training as T
from loomgraph.operators.training import Block

N = 14


@pytest.fixture(scope="module")
def graph_tables(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(N, 3))
    y = [None if i == 5 else int(i % 3) for i in range(N)]
    split = ["val" if i % 4 == 3 else "train" for i in range(N)]
    edges = [(int(a), int(b)) for a, b in r.integers(0, N - 1, (40, 2))]  # the last node has none
    nodes = spark.createDataFrame([(i, x[i].tolist(), y[i], split[i], "more") for i in range(N)], "id long, x array<double>, y int, split string, h string")
    return x, y, split, edges, nodes, spark.createDataFrame(edges, "src long, dst long")


def attend(score, message, edges):
    """Softmax by destination and head of score(src, dst), times message(src)."""
    out = np.zeros((N, *message.shape[1:]))
    for v in range(N):
        some = [a for a, b in edges if b == v]
        if some:
            s = np.array([score(u, v) for u in some])
            e = np.exp(s - s.max(0))
            out[v] = np.einsum("uh,uhd->hd", e / e.sum(0), message[some])
    return out.reshape(N, -1)


def convolved(block, w, h, edges):
    heads, d = block.heads, block.head
    lrelu = lambda z: np.where(z > 0, z, block.slope * z)
    cut = lambda m: m.reshape(N, heads, d)
    if block.conv == "gat":
        p = cut(h @ w["p.weight"].T)
        return attend(lambda u, v: lrelu((w["a_src"] * p[u]).sum(1) + (w["a_dst"] * p[v]).sum(1)), p, edges)
    if block.conv == "gatv2":
        left, right = cut(h @ w["left.weight"].T), cut(h @ w["right.weight"].T)
        return attend(lambda u, v: (w["attn"] * lrelu(left[v] + right[u])).sum(1), right, edges) @ w["out.weight"].T
    if block.conv == "graph_transformer":
        z = (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5)
        q, k, v = (cut(z @ w[f"{c}.weight"].T + w[f"{c}.bias"]) for c in "qkv")
        return attend(lambda a, b: (q[a] * k[b]).sum(1) / np.sqrt(d), v, edges)
    a = np.zeros((N, N))
    for u, v in edges:
        a[v, u] += 1
    out, into = np.maximum(a.sum(0), 1), np.maximum(a.sum(1), 1)
    return (a / np.sqrt(into[:, None] * out)) @ h if block.conv == "gcn" else (a / into[:, None]) @ h


def loss_of(model, weights, x, y, split, edges, seed, epoch, which="train", training=True):
    m = T.Model(model.blocks, weights, model.state)
    for k, block in enumerate(model.blocks):
        w = m.of(k)
        z = x @ w["weight"].T + w["bias"]
        h = {"prelu": lambda: np.where(z > 0, z, z * w["alpha"]), "tanh": lambda: np.tanh(z), "silu": lambda: z / (1 + np.exp(-z)), "identity": lambda: z}[block.act]()
        o = convolved(block, w, h, edges)
        if block.norm == "batch":
            mean, var = (o.mean(0), o.var(0)) if training else (m.state[f"{k}.mean"], m.state[f"{k}.var"])
            o = (o - mean) / np.sqrt(var + 1e-5)
        elif block.norm == "layer":
            o = (o - o.mean(1, keepdims=True)) / np.sqrt(o.var(1, keepdims=True) + 1e-5)
        elif block.norm == "rms":
            o = o / np.sqrt((o * o).mean(1, keepdims=True) + 1e-8)
        o = o * w.get("gamma", 1.0) + w.get("beta", 0.0)
        if block.dropout and training:
            o = o * T.kept(np.arange(N), block.width, block.dropout, T.dropout_key(seed, epoch, k))
        x = o + h if block.residual else o
    z = x @ weights["head.weight"].T + weights["head.bias"]
    rows = [i for i in range(N) if split[i] == which and y[i] is not None]
    return np.mean([np.log(np.exp(z[i] - z[i].max()).sum()) + z[i].max() - z[i, y[i]] for i in rows])


def warmed(blocks, seed):
    """A model whose vectors aren't zeros and ones."""
    model, r = T.new_model(blocks, 3, 3, seed), np.random.default_rng(seed)
    for name, w in model.weights.items():
        model.weights[name] = w + r.normal(0, 0.3, w.shape)
    return model


MODELS = {
    "gat, gatv2": [Block(4, "prelu", "gat", 2, "batch", 0.3), Block(3, "tanh", "gatv2", 2, "layer", 0.0, False)],
    "graph_transformer, gcn": [Block(4, "silu", "graph_transformer", 2, "rms", 0.2), Block(2, "identity", "gcn", norm="batch")],
    "gatv2, graph_transformer": [Block(2, "tanh", "gatv2", 1, "batch", 0.4, True, 0.1), Block(4, "prelu", "graph_transformer", 1, "none", 0.0, False)],
}


@pytest.mark.parametrize("name", MODELS)
def test_every_gradient(graph_tables, name):
    x, y, split, edges, nodes, edge_table = graph_tables
    model = warmed(MODELS[name], 7)
    loss, grads, state = T.gradients(nodes, edge_table, model, seed=3, epoch=5)
    value = lambda ws: loss_of(model, ws, x, y, split, edges, 3, 5)
    assert abs(loss - value(model.weights)) < 1e-9
    assert list(grads) == list(model.weights)
    for which, w in model.weights.items():
        want = np.zeros_like(w)
        for at in np.ndindex(*w.shape):
            moved = []
            for step in (1e-5, -1e-5):
                changed = w.copy()
                changed[at] += step
                moved.append(value({**model.weights, which: changed}))
            want[at] = (moved[0] - moved[1]) / 2e-5
        assert np.allclose(grads[which], want, atol=1e-7, rtol=1e-4), which
    # another task layout meets the same masks and the same statistics
    again, others, _ = T.gradients(nodes.repartition(7), edge_table.repartition(3), model, seed=3, epoch=5)
    assert abs(again - loss) < 1e-12 and all(np.allclose(others[k], g, atol=1e-12) for k, g in grads.items())
    scored = T.evaluate(nodes, edge_table, T.Model(model.blocks, model.weights, state), "val")[0]
    assert abs(scored - loss_of(T.Model(model.blocks, model.weights, state), model.weights, x, y, split, edges, 0, 0, "val", False)) < 1e-9


def test_dropout_drops_its_share_and_depends_on_the_epoch():
    ids = np.arange(-500, 500)
    first, second = (T.kept(ids, 40, 0.25, T.dropout_key(1, e, 0)) for e in (1, 2))
    assert abs((first == 0).mean() - 0.25) < 0.01 and np.allclose(first[first > 0], 4 / 3)
    assert 0.55 < ((first == 0) == (second == 0)).mean() < 0.7
    assert (T.kept(ids[::-1], 40, 0.25, T.dropout_key(1, 1, 0))[::-1] == first).all()


def close(a, b):
    """Runs are alike up to the order of sums."""
    arrays = lambda r: {**r.model.weights, **r.model.state, **{f"best {k}": v for k, v in r.best.weights.items()}, **{f"m{i} {k}": v for i, m in enumerate(r.moments) for k, v in m.items()}}
    x, y = arrays(a), arrays(b)
    same = [{k: h[k] if k in ("epoch", "val_accuracy") else h[k] and round(h[k], 8) for k in h} for h in a.history] == [{k: h[k] if k in ("epoch", "val_accuracy") else h[k] and round(h[k], 8) for k in h} for h in b.history]
    return same and x.keys() == y.keys() and all(np.allclose(x[k], y[k], atol=1e-8) for k in x) and (a.epoch, a.best_epoch, a.bad) == (b.epoch, b.best_epoch, b.bad)


def test_a_stopped_run_goes_on_and_leaves_no_tables(spark, graph_tables, tmp_path):
    *_, nodes, edges = graph_tables
    model = T.new_model([Block(3, "prelu", "mean", 1, "batch", 0.2)], 3, 3, 1)
    how = {"lr": 0.1, "check_every": 2, "patience": 9, "seed": 5}
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    whole = T.train(nodes, edges, model, epochs=4, **how)
    assert set(os.listdir(folder)) == before
    store = f"file://{tmp_path}/run"
    T.train(nodes, edges, model, epochs=1, store=store, **how)
    (tmp_path / "run" / "epoch-000000009").mkdir()  # a state without its mark was not published
    stopped = T.train(nodes, edges, model, epochs=4, store=store, **how)
    assert close(stopped, whole) and stopped.epoch == 4
    kept = T.Store(spark, store)
    assert kept.epochs() == [3, 4] and kept.latest().to_json() == stopped.to_json()
    assert T.train(nodes, edges, model, epochs=4, store=store, **how).to_json() == stopped.to_json()
    with pytest.raises(ValueError, match="another model"):
        T.train(nodes, edges, T.new_model([Block(2)], 3, 3), epochs=4, store=store)


def test_training_lowers_the_loss(graph_tables):
    *_, nodes, edges = graph_tables
    run = T.train(nodes, edges, T.new_model([Block(4, "tanh", "graph_transformer", 2, "layer")], 3, 3, 2), epochs=4, lr=0.1, check_every=4)
    assert run.history[-1]["loss"] < run.history[0]["loss"] and run.history[0]["val_accuracy"] is None and run.best_epoch == 4
    assert {r["pred"] for r in T.score(nodes, edges, run.best).collect()} <= {0, 1, 2}


def test_unknown_parts():
    for bad in ({"conv": "x"}, {"norm": "x"}, {"act": "x"}, {"dropout": 1.0}, {"conv": "gat", "heads": 3}):
        with pytest.raises(ValueError):
            Block(4, **bad)
