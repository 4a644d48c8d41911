"""Layers, preparation, metrics, reports and files on small tables with known results."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import vectors as V
from loomgraph.functions.positions import global_positions, quantiles, running_sum
from loomgraph.operators import metrics, nn, prepare, report
from loomgraph.plans import flows
from loomgraph.sources import io


def test_positions(spark):
    rows = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("v"), (F.col("id") % 3).alias("g")).repartition(5)
    assert all(r["pos"] == r["v"] for r in global_positions(rows, ["v"]).collect())
    sums = {(r["g"], r["v"]): r["s"] for r in running_sum(rows, ["v"], F.col("v"), "s", ["g"]).collect()}
    for g in range(3):
        vs = sorted(v for (h, v) in sums if h == g)
        assert [sums[g, v] for v in vs] == np.concatenate([[0], np.cumsum(vs)[:-1]]).tolist()


def test_normal_quantile_and_erf(spark):
    ps = [1e-7, 0.001, 0.02, 0.3, 0.5, 0.8, 0.99, 1 - 1e-7]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", V.normal_quantile(F.col("p")).alias("z"), V.erf(F.col("p") * 2).alias("e")).collect()
    for r in rows:
        assert abs(r["z"] - NormalDist().inv_cdf(r["p"])) < 1e-6 and abs(r["e"] - math.erf(2 * r["p"])) < 1e-6


def test_layers(spark):
    x = np.random.default_rng(1).normal(size=(20, 4))
    nodes = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>")
    get = lambda df, c="x": np.array([r[c] for r in df.orderBy("id").collect()])
    w = [[1.0, 2, 3, 4], [0.5, 0, -1, 1]]
    assert np.allclose(get(nn.linear(nodes, w, [1.0, -1.0])), x @ np.array(w).T + [1, -1])
    assert np.allclose(get(nn.normalize(nodes, "layer")), (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5))
    assert np.allclose(get(nn.normalize(nodes, "batch")), (x - x.mean(0)) / np.sqrt(x.var(0) + 1e-5))
    assert np.allclose(get(nn.normalize(nodes, "rms")), x / np.sqrt((x * x).mean(1, keepdims=True) + 1e-8))
    assert np.allclose(get(nn.activation(nodes, "gelu")), [[v * NormalDist().cdf(v) for v in row] for row in x], atol=1e-6)
    assert get(nn.classify(nodes, w), "pred").tolist() == (x @ np.array(w).T).argmax(1).tolist()
    assert nn.linear(nodes.limit(0), w).collect() == []


def test_training_learns(spark):
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 120)
    nodes = spark.createDataFrame([(i, [float(c), float(1 - c), float(z)], int(c), ["train", "train", "val", "test"][i % 4]) for i, (c, z) in enumerate(zip(y, r.normal(size=120)))], "id long, x array<double>, y int, split string")
    edges = spark.createDataFrame([(int(b), int(a)) for a in range(120) for b in r.choice(np.flatnonzero(y == y[a]), 2)], "src long, dst long")
    got = nn.fit(nodes, edges, 2, hops=1, conv="mean", epochs=12, lr=0.3, check_every=4, patience=2)
    assert got.history[-1]["loss"] < got.history[0]["loss"] and max(h["val_accuracy"] or 0 for h in got.history) == 1.0


@pytest.mark.parametrize("case", [("gcn", "none", {}), ("mean", "layer", {}), ("gatv2", "rms", {"attn": [[0.5, -0.3, 0.8]]}), ("graph_transformer", "none", {})])
def test_gradients_through_two_blocks(spark, case):
    """Against finite differences of the scoring functions."""
    conv, norm, extra = case
    r = np.random.default_rng(4)
    nodes = spark.createDataFrame([(i, r.normal(size=3).tolist(), int(i % 2), "train" if i % 3 else "val") for i in range(12)], "id long, x array<double>, y int, split string")
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in r.integers(0, 12, (30, 2))], "src long, dst long")
    layers = [nn.Layer(r.normal(size=(3, 3)).tolist(), r.normal(size=3).tolist(), "tanh", conv, norm, True, extra), nn.Layer(r.normal(size=(3, 3)).tolist(), r.normal(size=3).tolist(), "silu", "sum", "none", False)]
    head = (r.normal(size=(2, 3)).tolist(), r.normal(size=2).tolist())
    loss, found = nn.gradients(nodes, edges, layers, head)
    assert abs(loss - nn.evaluate(nodes, edges, layers, head, "train").first()["loss"]) < 1e-9

    def moved(k, at, step):
        ws = [[np.array(x.weight), np.array(x.bias)] for x in layers] + [[np.array(head[0]), np.array(head[1])]]
        ws[k][at[0]][at[1]] += step
        changed = [nn.Layer(w.tolist(), b.tolist(), x.act, x.conv, x.norm, x.residual, x.extra) for x, (w, b) in zip(layers, ws[:-1])]
        return nn.evaluate(nodes, edges, changed, (ws[-1][0].tolist(), ws[-1][1].tolist()), "train").first()["loss"]

    for k, at in ((0, (0, (1, 2))), (1, (1, 0)), (2, (0, (1, 1)))) if conv == "gcn" else ((0, (0, (1, 2))),):
        want = (moved(k, at, 1e-4) - moved(k, at, -1e-4)) / 2e-4
        assert abs(found[k][at[0]][at[1]] - want) < 1e-5 + 1e-3 * abs(want)


def test_training_through_layers(spark):
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 60)
    nodes = spark.createDataFrame([(i, [float(c) + float(z), float(z)], int(c), ["train", "train", "val"][i % 3]) for i, (c, z) in enumerate(zip(y, r.normal(size=60)))], "id long, x array<double>, y int, split string")
    edges = spark.createDataFrame([(int(b), int(a)) for a in range(60) for b in r.choice(np.flatnonzero(y == y[a]), 2)], "src long, dst long")
    got = nn.train(nodes, edges, [nn.Layer(r.normal(size=(3, 2)).tolist(), [0.0] * 3, "relu", "mean")], (r.normal(size=(2, 3)).tolist(), [0.0, 0.0]), epochs=4, lr=0.3, check_every=2)
    assert got.history[-1]["loss"] < got.history[0]["loss"] and got.history[0]["val_accuracy"] is None and got.history[1]["val_accuracy"] is not None


def test_quantiles(spark):
    r = np.random.default_rng(3)
    values = {"a": r.integers(0, 9, 200).astype(float), "b": r.normal(size=101), "c": np.array([5.0]), "d": np.array([2.0, 2.0, 7.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("e", None)], "g string, v double")
    for parts in (1, 4, 20, 999):
        found = {}
        for x in quantiles(rows, ["g"], "v", parts).collect():
            found.setdefault(x["g"], {})[x["i"]] = x["q"]
        assert found.keys() == values.keys()
        for k, vs in values.items():
            assert np.allclose([found[k][i] for i in range(parts + 1)], np.quantile(vs, np.linspace(0, 1, parts + 1)))


def test_dataset_checks(spark):
    rows = spark.createDataFrame([(1, [1.0], 0.5, True, False, True), (2, [2.0], None, True, True, True), (2, [None], 1.0, False, True, False)], "id long, x array<double>, y double, train boolean, val boolean, m boolean")
    c = prepare.check_dataset(rows, ["num"], "y", ["train", "val"], "m").first()
    assert (c["n_repeated"], c["n_length"], c["n_missing"], c["n_overlapping"], c["n_unlabelled"], c["ok"]) == (1, 0, 1, 1, 1, False)
    with pytest.raises(ValueError):
        prepare.fit_one_hot(rows, ["id"], most=1)
    split = prepare.index_split(rows.select("id").distinct(), {"train": spark.createDataFrame([(1,)], "id long"), "val": spark.createDataFrame([(3,)], "id long")})
    assert {r["id"]: r["split"] for r in split.collect()} == {1: "train", 2: None}


def test_preparation(spark):
    rows = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(zip([1.0, 2.0, 2.0, None, 9.0], ["b", "a", "b", None, "c"]))], "id long, v double, c string")
    assert prepare.fit_impute(rows, ["v"], "median") == {"v": 2.0} and prepare.fit_impute(rows, ["v"], "most_frequent") == {"v": 2.0}
    assert prepare.fit_one_hot(rows, ["c"]) == {"c": ["a", "b", "c"]} and prepare.fit_one_hot(rows.where("c in ('a', 'b')"), ["c"]) == {"c": ["b"]}
    assert prepare.fit_scale(rows.withColumn("v", F.lit(3.0)), ["v"], "standard") == {"v": (3.0, 1.0)}
    edges = prepare.fit_bins(rows.where("v is not null"), "v", "quantile", 4)
    v = np.array([1.0, 2.0, 2.0, 9.0])
    want = np.unique(np.quantile(v, np.linspace(0, 1, 5)))
    assert np.allclose(edges, [want[0] - 1e-6, *want[1:-1], want[-1] + 1e-6])
    a, b, c, d = (np.digitize(v, edges) - 1).tolist()
    assert [r["b"] for r in rows.orderBy("id").select(prepare.bin_target(F.col("v"), edges).alias("b")).collect()] == [a, b, c, None, d]
    u = [r["v"] for r in prepare.quantile_transform(rows, {"v": [1.0, 2.0, 2.0, 2.0, 9.0]}).orderBy("id").collect()]
    assert u == [0.0, 0.5, 0.5, None, 1.0]


def test_bundle_and_options(spark, tmp_path):
    r = np.random.default_rng(5)
    n = 60
    nodes = spark.createDataFrame([(i, None if i % 9 == 0 else float(r.normal()), float(i % 4), float(r.random()), i % 2, i % 4 if i else 7, None if i % 10 == 3 else float(i)) for i in range(n)], "id long, a double, b double, f double, two int, four int, y double")
    put = lambda df, name: df.write.option("header", True).csv(f"{tmp_path}/{name}.csv")
    put(nodes.select("id", "a", "b", "f", "two", "four"), "features")
    put(nodes.select("id", "y"), "targets")
    put(nodes.select("id", (F.col("id") % 3 == 0).alias("train"), (F.col("id") % 3 == 1).alias("val"), (F.col("id") % 3 == 2).alias("test")), "split_masks_TH")
    put(spark.createDataFrame([(int(a), int(b)) for a, b in r.integers(0, n, (200, 2))], "s long, t long"), "edgelist")
    meta = {"target_name": "y", "numerical_features_names": ["a", "b", "f"], "fraction_features_names": ["f"], "categorical_features_names": ["two", "four"], "task": "regression"}
    b = io.read_graph_bundle(spark, str(tmp_path), "TH", meta)
    assert b.numeric == ["a", "b"] and b.nodes.count() == n and b.edges.count() == 200
    for inductive in (False, True):
        p = flows.prepare_dataset(b, "quantile_normal", "most_frequent", bins=("quantile", 3), inductive=inductive)
        check = prepare.check_dataset(p.nodes, p.kinds).first()
        four = {i % 4 if i else 7 for i in range(n) if not inductive or i % 3 == 0}
        assert check["ok"] and check["n_nodes"] == n and p.kinds.count("cat") == len(four) + 1  # two levels of `two` make one slot
        if inductive:
            sizes = {k: (x.count(), e.count()) for k, (x, e, _) in p.snapshots.items()}
            assert sizes["test"] == (n, 200) and sizes["train"][0] == 20 and sizes["val"][0] == 40
    with pytest.raises(ValueError):
        flows.prepare_dataset(b, "cubic")


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 1, 0.1), (2, 0, 0.2)], "y int, pred int, score double")
    assert abs(metrics.accuracy(rows).first()[0] - 0.4) < 1e-12
    assert abs(metrics.f1(rows, "macro").first()[0] - (0.5 + 0.4 + 0) / 3) < 1e-12 and abs(metrics.f1(rows, "micro").first()[0] - 0.4) < 1e-12
    p = metrics.precision_recall(rows).first()
    assert (p["precision"], p["recall"]) == (0.5, 0.5)
    two = rows.where("y < 2")
    assert metrics.auc(two).first()[0] == (1 + 1 + 0.5 + 1) / 4
    empty = rows.limit(0)
    assert metrics.accuracy(empty).first()[0] == 0 and metrics.auc(rows.where("y = 1")).first()[0] == 0.5 and metrics.precision_recall(rows.where("pred = 0 and y = 0")).first()["recall"] == 0
    h = spark.createDataFrame(list(enumerate([0.1, 0.5, 0.4, 0.5, 0.3, 0.9])), "epoch long, value double")
    assert tuple(metrics.early_stop(h, 3).first()) == (1, 0.5, 4) and tuple(metrics.early_stop(h, 9).first()) == (5, 0.9, None)


def test_reports(spark):
    rows = spark.createDataFrame(
        [(1, "base", "g", 10.0), (2, "base", "g", 99.0), (3, "fast", "g", 5.0), (4, "bad", "g", 0.0), (5, "fast", "h", 5.0), (6, "nan", "g", float("nan"))], "run_id long, backend string, dataset string, ms double"
    ).withColumn("heads", F.lit(None).cast("int"))
    up = {r["run_id"]: r["ms_speedup"] for r in report.speedup(rows, "base", ["dataset", "heads"], ["ms"]).collect()}
    assert up == {1: 1.0, 2: 10 / 99, 3: 2.0, 4: None, 5: None, 6: None}
    assert report.drop_constant_columns(rows).columns == ["run_id", "backend", "dataset", "ms"]
    best = report.best_config(rows.where("ms > 0 and not isnan(ms)"), ["dataset"], ["backend"], "ms").orderBy("dataset").collect()
    assert [(r["dataset"], r["backend"]) for r in best] == [("g", "fast"), ("h", "fast")]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    path = io.write_processed(df, str(tmp_path), {"k": 1})
    io.write_processed(df.unionByName(df), str(tmp_path), {"k": 1})
    assert spark.read.parquet(path).count() == 1
    io.write_report(df, f"{tmp_path}/r")
    io.write_report(df.select("a").withColumn("c", F.lit(2)), f"{tmp_path}/s")
    got = io.read_measurements(spark, [f"{tmp_path}/r", f"{tmp_path}/s"]).orderBy("c").collect()
    assert [(r["a"], r["b"], r["c"]) for r in got] == [(1, "x", None), (1, None, 2)]
