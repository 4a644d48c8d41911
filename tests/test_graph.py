"""Analytic graphs, and numpy versions of the formulas on random ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import adjoint, aggregate, attention, graph
from loomgraph.sources import io


def frames(spark, n, edges, x, weights=None):
    nodes = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")
    rows = [(int(a), int(b), float(w)) for (a, b), w in zip(edges, weights if weights is not None else [1.0] * len(edges), strict=True)]
    return spark.createDataFrame(rows, "src long, dst long, w double"), nodes


def dense(df, column="out"):
    return np.array([r[column] for r in df.orderBy("id").collect()], float)


@pytest.fixture(scope="module")
def random_graph(spark):
    r = np.random.default_rng(0)
    n, e = 30, [tuple(p) for p in r.integers(0, 28, (150, 2))]  # the last two nodes are isolated
    x = r.normal(size=(n, 8))
    return n, e, x, *frames(spark, n, e, x, r.normal(size=150))


def matrix(n, edges):
    a = np.zeros((n, n))
    for s, d in edges:
        a[d, s] += 1
    return a


def test_star(spark):
    edges, nodes = frames(spark, 10, [(i, 0) for i in range(1, 10)], [[i] * 4 for i in range(10)])
    assert dense(aggregate.mean_aggr(edges, nodes))[0].tolist() == [5.0] * 4
    assert dense(aggregate.min_aggr(edges, nodes))[0].tolist() == [1.0] * 4
    assert dense(aggregate.max_aggr(edges, nodes))[0].tolist() == [9.0] * 4
    assert not dense(aggregate.max_aggr(edges, nodes))[1:].any()


def test_triangle_and_isolated(spark):
    edges, nodes = frames(spark, 3, [(a, b) for a in range(3) for b in range(3) if a != b], [[i] * 2 for i in range(3)])
    assert dense(aggregate.min_aggr(edges, nodes))[:, 0].tolist() == [1, 0, 0]
    assert dense(aggregate.max_aggr(edges, nodes))[:, 0].tolist() == [2, 2, 1]
    edges, nodes = frames(spark, 3, [(0, 1), (1, 0)], [[i + 1] for i in range(3)])
    assert dense(aggregate.min_aggr(edges, nodes))[:, 0].tolist() == [2, 1, 0]


def test_no_edges_and_no_nodes(spark):
    edges, nodes = frames(spark, 5, [], np.ones((5, 3)))
    for f in (aggregate.sum_aggr, aggregate.mean_aggr, aggregate.min_aggr, aggregate.gcn_aggr):
        assert dense(f(edges, nodes)).tolist() == np.zeros((5, 3)).tolist()
    empty = nodes.limit(0)
    assert aggregate.sum_aggr(edges, empty).collect() == []
    assert not graph.is_directed(edges) and graph.max_degree(graph.degrees(edges, nodes)).first()[0] == 0


def test_nan_and_infinity_never_win(spark):
    edges, nodes = frames(spark, 4, [(0, 3), (1, 3), (2, 3)], [[float("nan"), 1.0], [2.0, float("inf")], [5.0, 1.0], [0, 0]])
    row = aggregate.max_aggr(edges, nodes, return_arg=True).where("id = 3").first()
    assert (row["out"], row["arg"]) == ([5.0, 1.0], [2, 0])


def test_aggregations_equal_matrices(random_graph):
    n, e, x, edges, nodes = random_graph
    a = matrix(n, e)
    din, dout = np.maximum(a.sum(1), 1), np.maximum(a.sum(0), 1)
    assert np.allclose(dense(aggregate.sum_aggr(edges, nodes)), a @ x)
    assert np.allclose(dense(aggregate.mean_aggr(edges, nodes)), a @ x / din[:, None])
    gcn = a / np.sqrt(din)[:, None] / np.sqrt(dout)[None]
    assert np.allclose(dense(aggregate.gcn_aggr(edges, nodes)), gcn @ x)
    assert np.allclose(dense(aggregate.random_walk_aggr(edges, nodes)), a / dout[None] @ x)
    for norm, m in (("none", a), ("both", gcn), ("left", a / dout[None]), ("right", a / din[:, None])):
        assert np.allclose(dense(aggregate.spmm(edges, nodes, norm=norm)), m @ x)
        assert np.allclose(dense(aggregate.spmm(edges, nodes, norm=norm, transposed=True)), m.T @ x)
    assert np.allclose(dense(aggregate.dot_aggr(edges, nodes)), ((a @ x) * x).sum(1))


def softmax_by_head(n, e, score, value):
    out = np.zeros((n, value.shape[1]))
    for v in range(n):
        into = [i for i, (_, d) in enumerate(e) if d == v]
        if into:
            s = np.exp(score[into] - score[into].max())
            out[v] = (s / s.sum()) @ value[[e[i][0] for i in into]]
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_attention(random_graph, parts):
    n, e, x, edges, nodes = random_graph
    three = nodes.select("id", F.col("x").alias("q"), F.reverse("x").alias("k"), F.transform("x", lambda v: v + 1).alias("v"), F.col("x").alias("left"), F.reverse("x").alias("right"), F.col("x").alias("h"))
    q, k, v = x, x[:, ::-1], x + 1
    attn = np.array([[0.5, -1, 0.25, 2], [1, 1, -0.5, 0.1]])
    lrelu = lambda z: np.where(z > 0, z, 0.2 * z)
    for h in range(2):
        c = slice(4 * h, 4 * h + 4)
        s = np.array([q[a, c] @ k[b, c] / 2 for a, b in e])
        assert np.allclose(dense(attention.graph_transformer_aggr(edges, three, 2, heavy_parts=parts))[:, c], softmax_by_head(n, e, s, v[:, c]))
        s = np.array([attn[h] @ lrelu(q[b, c] + k[a, c]) for a, b in e])
        assert np.allclose(dense(attention.gatv2_aggr(edges, three, attn.tolist(), heavy_parts=parts))[:, c], softmax_by_head(n, e, s, k[:, c]))
        s = np.array([lrelu(attn[h] @ x[a, c] + attn[1 - h] @ x[b, c]) for a, b in e])
        assert np.allclose(dense(attention.gat_aggr(edges, three, attn.tolist(), attn[::-1].tolist(), heavy_parts=parts))[:, c], softmax_by_head(n, e, s, x[:, c]))


def test_gatv2_by_hand(spark):
    edges, nodes = frames(spark, 3, [(0, 1), (2, 1)], [[1, 3], [-1, 0], [2, 1]])
    both = nodes.select("id", F.col("x").alias("left"), F.col("x").alias("right"))
    lrelu = lambda z: np.where(z > 0, z, 0.2 * z)
    x = np.array([[1, 3], [-1, 0], [2, 1.0]])
    s = np.array([lrelu(x[u] + x[1]).sum() for u in (0, 2)])
    w = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    got = dense(attention.gatv2_aggr(edges, both, [[1.0, 1.0]]))
    assert np.allclose(got[1], w @ x[[0, 2]]) and not got[[0, 2]].any()


def test_gradients_by_finite_differences(spark):
    r = np.random.default_rng(3)
    n, e = 6, [(0, 1), (2, 1), (3, 1), (1, 0), (4, 0), (1, 2), (1, 2)]
    x, g = r.normal(size=(n, 6)), r.normal(size=(n, 2))
    attn = [[0.7, -0.4]]
    lrelu = lambda z: np.where(z > 0, z, 0.2 * z)

    def gt(y):
        s = np.array([y[a, :2] @ y[b, 2:4] * 0.7 for a, b in e])
        return (softmax_by_head(n, e, s, y[:, 4:]) * g).sum()

    def v2(y, w=attn[0]):
        s = np.array([np.array(w) @ lrelu(y[b, :2] + y[a, 2:4]) for a, b in e])
        return (softmax_by_head(n, e, s, y[:, 2:4]) * g).sum()

    def numeric(f):
        out = np.zeros_like(x)
        for i in np.ndindex(*x.shape):
            d = np.zeros_like(x)
            d[i] = 1e-6
            out[i] = (f(x + d) - f(x - d)) / 2e-6
        return out

    edges, nodes = frames(spark, n, e, x)
    cut = lambda i: F.slice("x", 2 * i + 1, 2)
    grad = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(g)], "id long, g array<double>")
    got = adjoint.gt_backward(edges, nodes.select("id", cut(0).alias("q"), cut(1).alias("k"), cut(2).alias("v")), grad, 1, 2, 0.7)
    want = numeric(gt)
    for i, c in enumerate(("gq", "gk", "gv")):
        assert np.allclose(dense(got, c), want[:, 2 * i : 2 * i + 2], atol=1e-6)
    got, ga = adjoint.gatv2_backward(edges, nodes.select("id", cut(0).alias("left"), cut(1).alias("right")), grad, attn)
    want = numeric(v2)
    assert np.allclose(dense(got, "gleft"), want[:, :2], atol=1e-6) and np.allclose(dense(got, "gright"), want[:, 2:4], atol=1e-6)
    want = [(v2(x, [0.7 + 1e-6 * (k == 0), -0.4 + 1e-6 * (k == 1)]) - v2(x, [0.7 - 1e-6 * (k == 0), -0.4 - 1e-6 * (k == 1)])) / 2e-6 for k in (0, 1)]
    assert np.allclose(ga.first()["gattn"], want, atol=1e-6)


def test_layouts(random_graph):
    n, e, _, edges, nodes = random_graph
    a = matrix(n, e)
    csr = graph.to_csr(edges, nodes).orderBy("id").collect()
    assert [r["row_start"] for r in csr] == np.concatenate([[0], np.cumsum(a.sum(1))[:-1]]).astype(int).tolist()
    assert all(r["neighbors"] == sorted(r["neighbors"]) for r in csr)
    back = sorted((r["src"], r["dst"]) for r in graph.from_csr(graph.to_csr(edges, nodes)).collect())
    assert back == sorted((int(s), int(d)) for s, d in e)
    m = graph.coalesce(edges)
    coded = graph.to_block_sparse(m)
    want = {(r["src"], r["dst"]): r["w"] for r in m.collect()}
    got = {(r["src"], r["dst"]): r["w"] for r in graph.from_block_sparse(coded).collect()}
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-12 for k in want)
    assert graph.block_stats(coded).first()["n_entries"] == len(want)


def test_small_layout(spark):
    edges, nodes = frames(spark, 3, [(0, 1), (1, 0), (1, 2), (2, 1)], np.ones((3, 1)))
    assert [(r["neighbors"], r["row_start"]) for r in graph.to_csr(edges, nodes).orderBy("id").collect()] == [([1], 0), ([0, 2], 1), ([1], 3)]
    assert not graph.is_directed(edges) and graph.is_directed(edges.where("src < 2"))


def test_buckets(spark):
    edges, nodes = frames(spark, 4, [(0, 1), (2, 1), (3, 1), (0, 2)], np.ones((4, 1)))
    deg = graph.degrees(edges, nodes)
    assert {r["bucket"] for r in graph.degree_bucket(deg, -1).collect()} == {"light"}
    assert [r["id"] for r in graph.degree_bucket(deg, 1.0).where("bucket = 'heavy'").collect()] == [1]


@pytest.mark.parametrize("kind", ["uniform", "undirected", "poisson"])
def test_generated_graphs(spark, kind):
    e = io.random_graph(spark, 50, 5, 3, kind)
    rows = e.collect()
    assert all(0 <= r["src"] < 50 and 0 <= r["dst"] < 50 for r in rows) and sorted(rows) == sorted(io.random_graph(spark, 50, 5, 3, kind).collect())
    if kind == "uniform":
        assert len(rows) == 250
    if kind == "undirected":
        assert not graph.is_directed(e) and len(set(rows)) == len(rows)
    if kind == "poisson":
        assert len(set(rows)) == len(rows) and all(r["src"] != r["dst"] for r in rows) and {r["dst"] for r in rows} == set(range(50))


def test_hub_spreads(spark):
    """A destination with most edges: the result doesn't depend on salting or the number of partitions."""
    edges = spark.range(4000).select((F.col("id") % 97).alias("src"), F.when(F.col("id") % 4 == 0, F.col("id") % 50).otherwise(0).alias("dst"))
    nodes = spark.range(100).select("id", F.array(F.col("id") / 100.0, F.col("id") % 3 / 1.0).alias("left"))
    nodes = nodes.withColumn("right", F.col("left"))
    one = dense(attention.gatv2_aggr(edges, nodes, [[1.0, -2.0]]))
    assert np.allclose(one, dense(attention.gatv2_aggr(edges.repartition(7), nodes, [[1.0, -2.0]], heavy_parts=8)))
