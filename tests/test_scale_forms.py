"""Forms for large and skewed tables give what the plain forms give: hubs dealt over copies, products on blocks, bounded parts, commit records."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import dealing, grid, packed
from loomgraph.operators import adjoint, aggregate, attention, graph, nn, prepare
from loomgraph.sources import io


@pytest.fixture(scope="module")
def star(spark):
    """Node 0 is a source of most edges and a destination of many; parallel edges and isolated nodes included."""
    r = np.random.default_rng(5)
    e = [(0, int(i % 37)) for i in range(300)] + [(int(a), int(b)) for a, b in r.integers(0, 37, (150, 2))] + [(int(a), 0) for a in r.integers(0, 37, 80)] + [(3, 4)] * 5
    x = r.normal(size=(40, 6))
    nodes = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>")
    return e, x, spark.createDataFrame([(a, b, float(k % 7)) for k, (a, b) in enumerate(e)], "src long, dst long, w double"), nodes


def values(df, column="out"):
    return np.array([r[column] for r in df.orderBy("id").collect()])


@pytest.mark.parametrize("quantile", [0.0, 0.5, 0.99])
def test_hubs_change_nothing(star, monkeypatch, quantile):
    *_, edges, nodes = star
    monkeypatch.setattr(aggregate, "HUB_EDGES", 20)
    monkeypatch.setattr(aggregate, "HUBS", 10 if quantile == 0.5 else 100)  # many hubs are joined, few are broadcast
    attn, three = [[0.5, -0.3, 0.8]] * 2, [[0.2, 0.4, -0.6]] * 2
    split = nodes.select("id", "x", *[F.col("x").alias(c) for c in ("left", "right", "q", "k", "v", "h")])
    for run in (
        lambda **h: aggregate.sum_aggr(edges, nodes, weight="w", **h), lambda **h: aggregate.mean_aggr(edges, nodes, **h), lambda **h: aggregate.max_aggr(edges, nodes, **h), lambda **h: aggregate.gcn_aggr(edges, nodes, **h),
        lambda **h: attention.gatv2_aggr(edges, split, attn, **h), lambda **h: attention.graph_transformer_aggr(edges, split, 2, **h), lambda **h: attention.gat_aggr(edges, split, attn, three, **h),
    )[:: 1 if quantile == 0.5 else 2]:
        assert np.allclose(values(run(hubs=quantile)), values(run()), atol=1e-12)


def test_a_hub_meets_several_copies(star, monkeypatch):
    e, _, edges, nodes = star
    monkeypatch.setattr(aggregate, "HUB_EDGES", 20)
    met = aggregate.gather(edges, nodes, {"x": "_x"}, hubs=0.99)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and met.count() == len(e)


@pytest.mark.parametrize("group", [1, 2048])
def test_product_on_blocks(star, monkeypatch, group):
    _, x, edges, nodes = star
    monkeypatch.setattr(graph, "GROUP_BLOCKS", group)
    matrix = graph.coalesce(edges)
    want = aggregate.spmm(matrix, nodes, weight="w")
    for rows, cols in ((16, 8), (4, 4), (8, 16)):
        blocks = graph.to_block_sparse(graph.transpose(matrix), rows, cols)
        assert np.allclose(values(graph.block_product(blocks, nodes, 6, rows=rows, cols=cols)), values(want))
    assert values(graph.block_product(graph.to_block_sparse(matrix.limit(0)), nodes, 6)).tolist() == np.zeros_like(x).tolist()


def test_product_joins_no_dense_row_to_a_column(star):
    *_, edges, nodes = star
    found = graph.block_product(graph.to_block_sparse(graph.transpose(graph.coalesce(edges))), nodes, 6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and np.allclose(values(found), values(aggregate.spmm(graph.coalesce(edges), nodes, weight="w")))


def test_bounded_parts(spark):
    r = np.random.default_rng(1)
    n = 120  # four communities whose ids alternate, so that the first parts cut most edges
    e = [(int(a), int(b)) for a in range(n) for b in r.choice(np.arange(a % 4, n, 4), 5)]
    nodes, edges = spark.range(n), spark.createDataFrame(e, "src long, dst long")
    start = graph.bounded_parts(edges, nodes, 36, rounds=0)
    parts = graph.bounded_parts(edges, nodes, 36, rounds=8)
    sizes = [x["count"] for x in parts.groupBy("part").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 36
    cut = [graph.edge_cut(edges, p).first()["n_cut"] for p in (start, parts)]
    assert cut[1] < 0.7 * cut[0]
    assert sorted(map(tuple, graph.bounded_parts(edges.repartition(5), nodes.repartition(3), 36, rounds=8).collect())) == sorted(map(tuple, parts.collect()))
    _, mapping = graph.reorder(edges, nodes, "parts", 8, 36)
    place = dict(map(tuple, mapping.collect()))
    assert sorted(place.values()) == list(range(n))
    in_order = [p for _, p in sorted((place[x["id"]], x["part"]) for x in parts.collect())]
    assert in_order == sorted(in_order)
    assert graph.bounded_parts(edges.limit(0), spark.range(0), 4).collect() == []
    with pytest.raises(ValueError):
        graph.bounded_parts(edges, nodes, 0)


def test_softmax_by_head(star):
    _, x, edges, nodes = star
    scores = attention.edge_dot(edges, nodes, "x", "x", 3, 6)
    soft = attention.edge_softmax(scores, heads=3).withColumn("galpha", F.array(F.col("src") * 1.0, F.col("dst") * 1.0, F.lit(1.0)))
    lse = dict(map(tuple, attention.edge_logsumexp(scores, nodes, heads=3).collect()))
    assert lse[39] == [float("-inf")] * 3
    for h in range(3):
        one = scores.select("src", "dst", F.col("score")[h].alias("score"))
        plain = attention.edge_softmax(one).withColumn("galpha", F.lit(1.0) * [F.col("src"), F.col("dst"), F.lit(1)][h])
        pick = lambda df: sorted((r[0], r[1], round(r[2], 9), round(r[3], 9)) for r in df.collect())
        back = adjoint.edge_softmax_backward(soft, heads=3).select("src", "dst", F.col("alpha")[h], F.col("gscore")[h])
        assert pick(back) == pick(adjoint.edge_softmax_backward(plain).select("src", "dst", "alpha", "gscore"))
        assert all(np.isclose(v, lse[i][h]) or v == lse[i][h] for i, v in attention.edge_logsumexp(one, nodes).collect())


def test_lists_that_overlap(spark):
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "id long")
    nodes = spark.range(4).withColumn("val", F.lit("old"))
    got = prepare.index_masks(nodes, {"train": ids(0, 1, 1), "val": ids(1, 2)}).orderBy("id").collect()
    assert [(r["id"], r["train"], r["val"]) for r in got] == [(0, True, False), (1, True, True), (2, False, True), (3, False, False)]
    got = prepare.index_split(nodes, {"train": ids(0, 0), "val": ids(2)}).orderBy("id").collect()
    assert [(r["id"], r["val"], r["split"]) for r in got] == [(0, "old", "train"), (1, "old", None), (2, "old", "val"), (3, "old", None)]
    with pytest.raises(Exception, match="more than one list"):
        prepare.index_split(nodes, {"train": ids(0, 1), "val": ids(1)}).collect()


def test_processed_folders_have_a_commit_record(spark, tmp_path, monkeypatch):
    one, two = spark.range(3), spark.range(5)
    rows = lambda p: spark.read.parquet(p).count()
    path = io.write_processed(one, str(tmp_path), {"k": 1, "a": "x"}, inputs=[one])
    assert rows(path) == 3 and json.loads((tmp_path / "a=x_k=1" / io.MANIFEST).read_text())["spec"] == {"a": "x", "k": "1"}
    assert rows(io.write_processed(two, str(tmp_path), {"k": 1, "a": "x"}, inputs=[spark.range(2, -1, -1)])) == 3  # the same inputs in another order
    assert rows(io.write_processed(two, str(tmp_path), {"k": 1, "a": "x"}, inputs=[two])) == 5  # other inputs
    assert rows(io.write_processed(one.withColumn("c", F.lit(1)), str(tmp_path), {"k": 1, "a": "x"})) == 3  # another schema
    (tmp_path / "a=x_k=1" / io.MANIFEST).unlink()
    assert rows(io.write_processed(two, str(tmp_path), {"k": 1, "a": "x"})) == 5  # unfinished
    # another writer publishes while this one writes
    real, done = io.json.dumps, []

    def late(record):
        if not done:
            done.append(1)
            io.write_processed(one, str(tmp_path), {"k": 2})
        return real(record)

    monkeypatch.setattr(io.json, "dumps", late)
    assert rows(io.write_processed(two.limit(4), str(tmp_path), {"k": 2})) == 3
    assert not list(tmp_path.glob("**/.unfinished*"))


def by_pair(df, *columns):
    return sorted((r["src"], r["dst"], *[x for c in columns for x in r[c]]) for r in df.collect())


@pytest.mark.parametrize("edges_a_cell", [16, 1 << 20])
def test_scores_on_a_grid(star, monkeypatch, edges_a_cell):
    """Scores, softmax and its gradient by cells equal those of joined edges; no join carries vectors along edges."""
    e, x, edges, nodes = star
    monkeypatch.setattr(grid, "MOST", edges_a_cell)
    edges = edges.unionByName(edges.limit(1).selectExpr("999L as src", "dst", "w")).withColumn("g", F.array(F.col("w") - 3, F.col("w") * 0.5))
    nodes = nodes.where("id < 39")
    scores = attention.edge_dot(edges, nodes, "x", "x", 2)
    assert "Join" not in scores._jdf.queryExecution().optimizedPlan().toString()
    want = sorted((a, b, *(x[a].reshape(2, 3) * x[b].reshape(2, 3)).sum(1)) for a, b in e)
    assert np.allclose(by_pair(scores, "score"), want)
    both = attention.dot_softmax(edges, nodes, "x", "x", 2, grad="g")
    joined = edges.join(nodes.select(F.col("id").alias("src")), "src").select("src", "dst", "w", "g")
    joined = joined.join(nodes.select(F.col("id").alias("src"), F.col("x").alias("a")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("x").alias("b")), "dst")
    soft = attention.edge_softmax(joined.select("src", "dst", "g", attention.head_dots(F.col("a"), F.col("b"), 2, 3).alias("score")), heads=2)
    assert np.allclose(by_pair(both, "alpha", "gscore"), by_pair(adjoint.edge_softmax_backward(soft, grad="g", heads=2), "alpha", "gscore"))
    lse = {r["id"]: r["lse"] for r in attention.dot_logsumexp(edges, nodes, "x", "x", 2).collect()}
    plain = {r["id"]: r["lse"] for r in attention.edge_logsumexp(scores, nodes, heads=2).collect()}
    assert lse.keys() == plain.keys() and all(np.allclose(lse[k], plain[k]) for k in lse)


def test_grid_keeps_infinite_scores_apart(spark, monkeypatch):
    """A score of minus infinity in one cell adds nothing to the sums of another; a destination without finite scores has no finite result."""
    monkeypatch.setattr(grid, "MOST", 1)
    nodes = spark.createDataFrame([(0, [float("-inf")], [1.0]), (1, [2.0], [1.0]), (2, [3.0], [1.0])], "id long, q array<double>, k array<double>")
    edges = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (0, 2)], "src long, dst long")
    lse = {r["id"]: r["lse"][0] for r in attention.dot_logsumexp(edges, nodes).collect()}
    assert np.isclose(lse[1], np.log(np.exp(2) + np.exp(3))) and lse[0] == lse[2] == -np.inf


def test_gradients_on_a_grid(star, monkeypatch):
    """Many cells give what one cell gives, and no plan of a gradient joins edges to rows of nodes."""
    *_, edges, nodes = star
    split = nodes.select("id", *[F.col("x").alias(c) for c in ("left", "right", "q", "k", "v", "h")])
    grad, attn, three = nodes.select("id", F.reverse("x").alias("g")), [[0.5, -0.3, 0.8]] * 2, [[0.2, 0.4, -0.6]] * 2

    def found():
        v2, total = adjoint.gatv2_backward(edges, split, grad, attn)
        out = [(v2, ("gleft", "gright")), (adjoint.gt_backward(edges, split, grad, 2, 3), ("gq", "gk", "gv")), (adjoint.gat_backward(edges, split, grad, attn, three), ("gs", "gd", "gv"))]
        assert not any("src" in df._jdf.queryExecution().optimizedPlan().toString() for df, _ in out)
        return [values(df, c) for df, cs in out for c in cs] + [np.array(total.first()["gattn"])]

    one = found()
    monkeypatch.setattr(grid, "MOST", 16)
    assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(one, found(), strict=True))


def test_many_pairs_are_grouped_in_bounded_tasks(star, monkeypatch):
    """Beyond FEW rows groupings of pairs run on as many partitions as their rows ask for, with equal results."""
    *_, edges, nodes = star
    runs = {
        "normalized": lambda: graph.normalized_adjacency(edges, nodes).select("src", "dst", F.round("w", 9)),
        "directed": lambda: graph.undirectedness(edges),
        "labels": lambda: graph.label_propagation(edges, nodes, 2),
    }
    plain = {n: sorted(map(tuple, f().collect())) for n, f in runs.items()}
    monkeypatch.setattr(dealing, "FEW", 10)
    monkeypatch.setattr(dealing, "ROWS", 50)
    assert {n: sorted(map(tuple, f().collect())) for n, f in runs.items()} == plain
    assert dealing.dealt(edges, "src", "dst").groupBy("src", "dst").count().rdd.getNumPartitions() == -(-edges.count() // 50)
    assert "RepartitionByExpression" in graph.normalized_adjacency(edges, nodes)._jdf.queryExecution().optimizedPlan().toString()


def test_args_of_extremes_meet_cells_of_a_grid_and_sort_nothing_wide(spark, monkeypatch):
    """Hash aggregation does not take minima of structs; ties, values that are not finite and nodes without edges, in one cell or many."""
    inf, nan = float("inf"), float("nan")
    nodes = spark.createDataFrame([(1, [5.0, inf]), (2, [5.0, nan]), (3, [-1.0, 2.0]), (4, [9.0, 2.0]), (5, [0.0, 0.0])], "id long, x array<double>")
    edges = spark.createDataFrame([(2, 5), (1, 5), (4, 3), (3, 3), (3, 3), (1, 1), (2, 1), (9, 1), (2, 2)], "src long, dst long")
    want = {1: ([5.0, 0.0], [1, None], [5.0, 0.0], [1, None]), 2: ([5.0, 0.0], [2, None], [5.0, 0.0], [2, None]), 3: ([-1.0, 2.0], [3, 3], [9.0, 2.0], [4, 3]), 4: ([0.0, 0.0], None, [0.0, 0.0], None), 5: ([5.0, 0.0], [1, None], [5.0, 0.0], [1, None])}
    for most in (6 << 20, 1):
        monkeypatch.setattr(grid, "EXTREME_EDGES", most)
        both = aggregate.min_max_aggr(edges, nodes)
        assert {r["id"]: tuple(r)[1:] for r in both.collect()} == want
        low = aggregate.min_aggr(edges, nodes, return_arg=True)
        assert {r["id"]: (r["out"], r["arg"]) for r in low.collect()} == {k: v[:2] for k, v in want.items()}
        assert "SortAggregate" not in low._jdf.queryExecution().toString()


@pytest.mark.parametrize("pack", [1 << 20, 50])
def test_passes_over_packed_edges(star, monkeypatch, pack):
    """Parallel edges, edges without an end among the nodes and ids of all sizes; one cell or several."""
    e, x, edges, nodes = star
    monkeypatch.setattr(packed, "PACK", pack)
    monkeypatch.setattr(packed, "STEP", 1 << 17 if pack > 50 else 20)
    far = lambda c: F.when(F.col(c) == 7, F.lit(-(2**63))).when(F.col(c) == 8, F.lit(2**63 - 1)).otherwise(F.col(c))
    extra = edges.sparkSession.createDataFrame([(99, 0), (5, 98), (None, 3), (4, None)], "src long, dst long")
    edges, nodes = edges.select("src", "dst").union(extra).select(far("src").alias("src"), far("dst").alias("dst")), nodes.select(far("id").alias("id"), F.col("x").alias("v"))
    p = packed.packed(edges, 40, 6)
    assert p.edges == len(e) + 3 and (p.blocks(40, 8) > 1) == (pack == 50)
    known = nodes.select("id")
    for back in (False, True):
        one, other = ("dst", "src") if back else ("src", "dst")
        want = edges.join(nodes.withColumnRenamed("id", one), one).join(known.withColumnRenamed("id", other), other).groupBy(F.col(other).alias("id")).agg(F.array(*[F.sum(F.col("v")[i]) for i in range(6)]).alias("v"))
        got = packed.sums(p, 40, nodes, nodes, 6, back)
        assert [r["id"] for r in got.orderBy("id").collect()] == [r["id"] for r in want.orderBy("id").collect()] and np.allclose(values(got, "v"), values(want, "v"), atol=1e-12)
    there = edges.join(known.withColumnRenamed("id", "src"), "src")
    outs, ins = ({r["id"]: r["count"] for r in df.groupBy(F.col(c).alias("id")).count().collect()} for df, c in ((there, "src"), (there.join(known.withColumnRenamed("id", "dst"), "dst"), "dst")))
    for r in packed.degrees(p, 40, nodes).collect():
        assert (r["outs"], r["ins"]) == (outs.get(r["id"], 0), ins.get(r["id"], 0))


def classifier(spark, n):
    r = np.random.default_rng(6)
    nodes = spark.createDataFrame([(i, r.normal(size=3).tolist(), i % 2, "train") for i in range(n)], "id long, x array<double>, y int, split string")
    layers = [nn.Layer(r.normal(size=(3, 3)).tolist(), [0.1] * 3, "tanh", conv) for conv in ("gcn", "mean", "random_walk")]
    return r, nodes, layers, (r.normal(size=(2, 3)).tolist(), [0.0, 0.0])


def test_gradients_shuffle_few_bytes_an_edge(spark):
    """Each pass shuffled pairs of ids and sums of nearly as many rows."""
    r, nodes, layers, head = classifier(spark, 1000)
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in r.integers(0, 1000, (200_000, 2))], "src long, dst long").cache()
    edges.count()

    def bytes_so_far() -> int:
        bus.waitUntilEmpty()
        every = store.executorList(True)
        return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
    try:
        before = bytes_so_far()
        nn.gradients(nodes, edges, layers, head)
        assert bytes_so_far() - before < 7 * 200_000 * 5  # seven passes; plain edges took 14.6 MB, packed ones 4.2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        edges.unpersist()


def test_gradients_leave_edges_from_unknown_nodes_out(spark):
    """They don't count in the mean, neither forward nor backward."""
    r, nodes, layers, head = classifier(spark, 9)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 9, (30, 2))]
    get = lambda e: nn.gradients(nodes, spark.createDataFrame(e, "src long, dst long"), layers[1:2], head)[1]
    for (w, b), (v, c) in zip(get([*pairs, (50, 1), (51, 1), (52, 3)]), get(pairs), strict=True):
        assert np.allclose(w, v, atol=1e-12) and np.allclose(b, c, atol=1e-12)
    assert all(np.isfinite(w).all() for w, _ in nn.gradients(nodes, spark.createDataFrame([], "src long, dst long"), layers, head)[1])
