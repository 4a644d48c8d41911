"""Queries for dense layers, feature preparation, metrics, reports and files, each with SQL that gives the same rows."""

from __future__ import annotations


import uuid

from pyspark.sql import functions as F


from .functions import vectors as V
from .functions.positions import global_positions
from .functions.scratch import shared_dir
from .operators.graph import relabelled
from .operators import metrics, nn, prepare, report, training
from .plans import flows
from .queries import BOUGHT, PARTS, SIZE, SQL, VECTOR_EDGES, VECTORS, bought_together, long, parts, query, rounded, rsql, table, vector_edges, vectors
from .sources import io

# ---- dense layers: weights from a formula ------------------------------------------------------------------------------


def weights(rows: int, cols: int, shift: int = 0) -> list[list[float]]:
    return [[((i * 7 + j * 3 + shift) % 11 - 5) / 10 for j in range(cols)] for i in range(rows)]


def bias(rows: int) -> list[float]:
    return [(i % 3 - 1) / 5 for i in range(rows)]


def lin(x: str, rows: int, cols: int, shift: int = 0, with_bias: bool = True) -> str:
    """SQL of the list W x + b."""
    return "[" + ", ".join(" + ".join(f"({w}) * {x}[{j + 1}]" for j, w in enumerate(row)) + (f" + ({b})" if with_bias else "") for row, b in zip(weights(rows, cols, shift), bias(rows), strict=True)) + "]"


def unnested(e: str, width: int, source: str, n: int = 6) -> str:
    return f"SELECT id, slot, {rsql('v', n)} AS value FROM (SELECT id, unnest(range({width})) AS slot, unnest({e}) AS v FROM {source})"


P = f"WITH {PARTS}"


@query(f"{P} {unnested(lin('x', 3, SIZE), 3, 'nodes')}")
def linear(s, d):
    return long(nn.linear(parts(s, d), weights(3, SIZE), bias(3), out="out"))


ACTS = {
    "relu": "greatest(z, 0.0)", "prelu": "CASE WHEN z > 0 THEN z ELSE 0.25 * z END", "elu": "CASE WHEN z > 0 THEN z ELSE exp(z) - 1 END",
    "tanh": "(exp(2 * z) - 1) / (exp(2 * z) + 1)", "sigmoid": "1 / (1 + exp(-z))", "silu": "z / (1 + exp(-z))", "identity": "z",
}


@query(f"{P}, l AS (SELECT id, unnest(range({SIZE})) AS slot, 4 * unnest(x) - 2 AS z FROM nodes) SELECT id, slot, " + ", ".join(f"{rsql(e)} AS {n}" for n, e in ACTS.items()) + " FROM l")
def activations(s, d):
    n = parts(s, d).withColumn("x", F.transform("x", lambda v: 4 * v - 2))
    wide = n.select("id", *[F.transform("x", nn.ACTIVATIONS[a]).alias(a) for a in ACTS])
    z = wide.select("id", F.posexplode(F.arrays_zip(*ACTS)).alias("slot", "z"))
    return z.select("id", F.col("slot").cast("long").alias("slot"), *[rounded(F.col(f"z.{a}")).alias(a) for a in ACTS])


@query(f"{P}, l AS (SELECT id, unnest(range({SIZE})) AS slot, unnest(x) AS v FROM nodes) SELECT id, slot, {rsql('(v - avg(v) OVER r) / sqrt(var_pop(v) OVER r + 1e-5)', 5)} AS layer, {rsql('v / sqrt(avg(v * v) OVER r + 1e-8)', 5)} AS rms, {rsql('(v - avg(v) OVER c) / sqrt(var_pop(v) OVER c + 1e-5)', 5)} AS batch FROM l WINDOW r AS (PARTITION BY id), c AS (PARTITION BY slot)")
def normalizations(s, d):
    n = parts(s, d)
    mean, var = nn.batch_stats(n, SIZE)
    z = n.select("id", F.posexplode(F.arrays_zip(nn.layer_norm(F.col("x")).alias("layer"), nn.rms_norm(F.col("x")).alias("rms"), nn.batch_norm(F.col("x"), mean, var).alias("batch"))).alias("slot", "z"))
    return z.select("id", F.col("slot").cast("long").alias("slot"), *[rounded(F.col(f"z.{c}"), 5).alias(c) for c in ("layer", "rms", "batch")])


@query(f"WITH {VECTORS}, l AS (SELECT id, unnest(range(64)) AS slot, unnest(x) AS v FROM nodes), w AS (SELECT *, avg(v) OVER r AS m, var_pop(v) OVER r AS q, avg(v * v) OVER r AS ms, avg(v) OVER c AS bm, var_pop(v) OVER c AS bv FROM l WINDOW r AS (PARTITION BY id), c AS (PARTITION BY slot)), s AS (SELECT id, exp(v) / sum(exp(v)) OVER (PARTITION BY id) AS p, slot FROM l) SELECT id, slot, {rsql('(v - m) / sqrt(q + 1e-5)', 5)} AS layer, {rsql('v / sqrt(ms + 1e-8)', 5)} AS rms, {rsql('(v - bm) / sqrt(bv + 1e-5)', 5)} AS batch, {rsql('p')} AS softmax FROM w JOIN s USING (id, slot)")
def normalizations_wide(s, d):
    """Rows of 64 slots, whose totals are worked out once a row."""
    n = vectors(s, d)
    mean, var = nn.batch_stats(n, 64)
    z = n.select("id", F.posexplode(F.arrays_zip(nn.layer_norm(F.col("x")).alias("layer"), nn.rms_norm(F.col("x")).alias("rms"), nn.batch_norm(F.col("x"), mean, var).alias("batch"), V.softmax(F.col("x")).alias("softmax"))).alias("slot", "z"))
    return z.select("id", F.col("slot").cast("long").alias("slot"), *[rounded(F.col(f"z.{c}"), 5).alias(c) for c in ("layer", "rms", "batch")], rounded(F.col("z.softmax")).alias("softmax"))


@query(f"{P}, w AS (SELECT id, {lin('x', 6, SIZE, 0, False)} AS y FROM nodes), l AS (SELECT id, unnest(range(2)) AS slot, unnest(y[1:2]) AS q, unnest(y[3:4]) AS k, unnest(y[5:6]) AS v FROM w) SELECT id, slot, {rsql('q')} AS q, {rsql('k')} AS k, {rsql('v')} AS v FROM l")
def qkv_split(s, d):
    z = nn.qkv_split(parts(s, d), weights(6, SIZE)).select("id", F.posexplode(F.arrays_zip("q", "k", "v")).alias("slot", "z"))
    return z.select("id", F.col("slot").cast("long").alias("slot"), *[rounded(F.col(f"z.{c}")).alias(c) for c in "qkv"])


LAYERS = [nn.Layer(weights(SIZE, SIZE), bias(SIZE), "relu", "gcn"), nn.Layer(weights(SIZE, SIZE, 4), bias(SIZE), "tanh", "mean", "none", False)]
HEAD = (weights(3, SIZE, 2), bias(3))
DEGREES = "dout AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY 1), din AS (SELECT dst AS id, count(*) AS n FROM edges GROUP BY 1)"
BLOCK1 = f"h1 AS (SELECT id, list_transform({lin('x', SIZE, SIZE)}, lambda v: greatest(v, 0.0)) AS x FROM nodes), l1 AS (SELECT id, unnest(range({SIZE})) AS slot, unnest(x) AS v FROM h1), c1 AS (SELECT e.dst AS id, slot, sum(v / sqrt(o.n * i.n)) AS v FROM edges e JOIN l1 ON l1.id = e.src JOIN dout o ON o.id = e.src JOIN din i ON i.id = e.dst GROUP BY 1, 2), b1 AS (SELECT l1.id, l1.slot, l1.v + coalesce(c1.v, 0) AS v FROM l1 LEFT JOIN c1 USING (id, slot))"
BLOCK2 = f"x1 AS (SELECT id, list(v ORDER BY slot) AS x FROM b1 GROUP BY 1), h2 AS (SELECT id, list_transform({lin('x', SIZE, SIZE, 4)}, lambda v: (exp(2 * v) - 1) / (exp(2 * v) + 1)) AS x FROM x1), l2 AS (SELECT id, unnest(range({SIZE})) AS slot, unnest(x) AS v FROM h2), c2 AS (SELECT e.dst AS id, slot, avg(v) AS v FROM edges e JOIN l2 ON l2.id = e.src GROUP BY 1, 2), b2 AS (SELECT l2.id, l2.slot, coalesce(c2.v, 0) AS v FROM l2 LEFT JOIN c2 USING (id, slot))"
LOGITS = f"x2 AS (SELECT id, list(v ORDER BY slot) AS x FROM b2 GROUP BY 1), z AS (SELECT x2.id, {lin('x2.x', 3, SIZE, 2)} AS logits, y, split FROM x2 JOIN nodes USING (id)), p AS (SELECT *, list_position(logits, list_max(logits)) - 1 AS pred, ln(list_sum(list_transform(logits, lambda v: exp(v)))) - logits[y + 1] AS loss FROM z)"
MODEL = f"WITH {BOUGHT}, {PARTS}, {DEGREES}, {BLOCK1}"


@query(f"{MODEL} SELECT id, slot, {rsql('v')} AS value FROM b1")
def residual_block(s, d):
    return long(nn.residual_block(parts(s, d), bought_together(s, d), LAYERS[0]), "x")


@query(f"{MODEL}, {BLOCK2} SELECT id, slot, {rsql('v', 5)} AS value FROM b2")
def encoder(s, d):
    return long(nn.encode(parts(s, d), bought_together(s, d), LAYERS), "x", 5)


@query(f"{MODEL}, {BLOCK2}, {LOGITS} SELECT {rsql('avg(loss)', 5)} AS loss, {rsql('avg((y = pred)::INT)')} AS accuracy FROM p WHERE split = 'val'")
def evaluate(s, d):
    return nn.evaluate(parts(s, d), bought_together(s, d), LAYERS, HEAD, "val").select(rounded(F.col("loss"), 5).alias("loss"), rounded(F.col("accuracy")).alias("accuracy"))


LOOPED = BOUGHT.replace("edges AS (", "edges AS (SELECT p_partkey AS src, p_partkey AS dst FROM part UNION ALL ", 1)


@query(f"WITH {LOOPED}, {PARTS}, {DEGREES}, {BLOCK1}, {BLOCK2}, {LOGITS} SELECT split, count(*)::BIGINT AS n, {rsql('avg((y = pred)::INT)')} AS accuracy FROM p GROUP BY 1")
def score_classifier(s, d):
    """The flagship: a stored two-block classifier over the graph of parts bought together."""
    return flows.score_classifier(parts(s, d), bought_together(s, d), LAYERS, HEAD).withColumn("accuracy", rounded(F.col("accuracy")))


SPREAD = f"WITH {VECTOR_EDGES}, {VECTORS}, long AS (SELECT id, unnest(range(64)) AS slot, unnest(x) AS v FROM nodes), m AS (SELECT e.dst AS id, slot, avg(v) AS v FROM edges e JOIN long l ON l.id = e.src GROUP BY 1, 2), feats AS (SELECT l.id, l.slot, coalesce(m.v, 0) AS v FROM long l LEFT JOIN m USING (id, slot) UNION ALL SELECT id, 64, 1 FROM nodes), t AS (SELECT id, y FROM nodes WHERE id % 5 < 3), g AS (SELECT c.range AS class, slot, -0.2 * avg(v * (0.1 - (y = c.range)::INT)) AS value FROM feats JOIN t USING (id), range(10) c GROUP BY 1, 2)"


@query(f"{SPREAD} SELECT class, slot, {rsql('value')} AS value FROM g")
def fitted_step(s, d):
    """Weights and bias (slot 64) of a softmax regression after one step from zero, on features spread over one hop."""
    n = vectors(s, d).withColumn("split", F.when(F.col("id") % 5 < 3, "train").when(F.col("id") % 5 == 3, "val").otherwise("test"))
    got = nn.fit(n, vector_edges(s, d), 10, hops=1, conv="mean", epochs=1, lr=0.2, check_every=1, optimizer="sgd")
    rows = [(c, k, float(v)) for c in range(10) for k, v in enumerate([*got.weight[c], got.bias[c]])]
    return s.createDataFrame(rows, "class long, slot long, value double").withColumn("value", rounded(F.col("value")))


def values_sql(name: str, matrix: list[list[float]]) -> str:
    return f"{name}(o, i, w) AS (VALUES " + ", ".join(f"({o}, {i}, {v!r}::DOUBLE)" for o, row in enumerate(matrix) for i, v in enumerate(row)) + ")"


STEP_BACK = ", ".join([
    values_sql("wh", HEAD[0]), values_sql("w2", LAYERS[1].weight), values_sql("w1", LAYERS[0].weight),
    "tr AS (SELECT id, y, logits FROM p WHERE split = 'train')",
    "gl AS (SELECT id, k.range AS o, (exp(logits[k.range + 1]) / list_sum(list_transform(logits, lambda v: exp(v))) - (y = k.range)::INT) / (SELECT count(*) FROM tr) AS g FROM tr, range(3) k)",
    "gx2 AS (SELECT id, i AS slot, sum(g * w) AS g FROM gl JOIN wh USING (o) GROUP BY 1, 2)",
    "gh2 AS (SELECT e.src AS id, slot, sum(g / i.n) AS g FROM edges e JOIN gx2 ON gx2.id = e.dst JOIN din i ON i.id = e.dst GROUP BY 1, 2)",
    "gz2 AS (SELECT id, slot AS o, g * (1 - l2.v * l2.v) AS g FROM gh2 JOIN l2 USING (id, slot))",
    "gx1 AS (SELECT id, i AS slot, sum(g * w) AS g FROM gz2 JOIN w2 USING (o) GROUP BY 1, 2)",
    "gh1 AS (SELECT id, slot, sum(g) AS g FROM (SELECT * FROM gx1 UNION ALL SELECT e.src AS id, slot, g / sqrt(o.n * i.n) FROM edges e JOIN gx1 ON gx1.id = e.dst JOIN dout o ON o.id = e.src JOIN din i ON i.id = e.dst) GROUP BY 1, 2)",
    "gz1 AS (SELECT id, slot AS o, CASE WHEN l1.v > 0 THEN g ELSE 0 END AS g FROM gh1 JOIN l1 USING (id, slot))",
    "xs AS (SELECT id, unnest(range(4)) AS slot, unnest(x) AS v FROM nodes), x1s AS (SELECT id, slot, v FROM b1), x2s AS (SELECT id, slot, v FROM b2)",
])
STEP_ROWS = " UNION ALL ".join(f"SELECT {k} AS layer, o, x.slot AS i, {rsql('sum(g * x.v)')} AS value FROM {g} JOIN {x} x USING (id) GROUP BY 2, 3 UNION ALL SELECT {k}, o, -1, {rsql('sum(g)')} FROM {g} GROUP BY 2" for k, g, x in ((0, "gz1", "xs"), (1, "gz2", "x1s"), (2, "gl", "x2s")))


@query(f"{MODEL}, {BLOCK2}, {LOGITS}, {STEP_BACK} {STEP_ROWS}")
def layer_gradients(s, d):
    """Gradients of all weights and biases (i = -1) of the two-block classifier and its head."""
    _, found = nn.gradients(parts(s, d), bought_together(s, d), LAYERS, HEAD)
    rows = [(k, o, i, float(v)) for k, (w, b) in enumerate(found) for o in range(len(b)) for i, v in [*enumerate(w[o]), (-1, b[o])]]
    return s.createDataFrame(rows, "layer int, o int, i long, value double").withColumn("value", rounded(F.col("value")))


# ---- one training step of an attention block: long rows (id, slot) all the way, edges numbered because parallel ones count each ----

STEP = training.new_model([training.Block(4, "prelu", "gatv2", 1, "batch")], 64, 10, 3)
STEP.weights |= {"0.gamma": STEP.weights["0.gamma"] * 1.5, "0.bias": STEP.weights["0.bias"] + 0.1, "head.bias": STEP.weights["head.bias"] - 0.2}


def of_step(name: str) -> str:
    w = STEP.weights[name]
    return values_sql("w_" + name.replace(".", "_"), w.tolist() if w.ndim > 1 else [[x] for x in w.tolist()])


TRAIN_SPLIT = VECTORS.replace("label::BIGINT AS y", "label::BIGINT AS y, CASE WHEN vec_id % 5 < 3 THEN 'train' WHEN vec_id % 5 = 3 THEN 'val' ELSE 'test' END AS split")
ATTENTION_STEP = ", ".join([
    f"WITH {TRAIN_SPLIT}, {VECTOR_EDGES}", *map(of_step, STEP.weights),
    "en AS MATERIALIZED (SELECT row_number() OVER () AS k, src, dst FROM edges)", "nx AS MATERIALIZED (SELECT id, unnest(range(64)) AS i, unnest(x) AS v FROM nodes)",
    "z AS MATERIALIZED (SELECT id, o, sum(nx.v * m.w) + any_value(b.w) AS v FROM nx JOIN w_0_weight m USING (i) JOIN w_0_bias b USING (o) GROUP BY 1, 2)",
    "h AS MATERIALIZED (SELECT id, o, CASE WHEN v > 0 THEN v ELSE v * w END AS v FROM z JOIN w_0_alpha USING (o))",
    *[f"p_{n} AS MATERIALIZED (SELECT id, m.o AS j, sum(v * w) AS v FROM h JOIN w_0_{n}_weight m ON m.i = h.o GROUP BY 1, 2)" for n in ("left", "right")],
    'u AS MATERIALIZED (SELECT k, src, dst, a.j, a.v + b.v AS u, b.v AS r, w AS att FROM en JOIN p_left a ON a.id = dst JOIN p_right b ON b.id = src AND b.j = a.j JOIN w_0_attn t ON t.i = a.j)',
    "sc AS (SELECT k, src, dst, sum(att * CASE WHEN u > 0 THEN u ELSE 0.2 * u END) AS s FROM u GROUP BY 1, 2, 3)",
    "al AS MATERIALIZED (SELECT k, src, dst, e / sum(e) OVER (PARTITION BY dst) AS al FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY dst)) AS e FROM sc))",
    "c AS MATERIALIZED (SELECT h.id, o AS j, coalesce(f.v, 0) AS v FROM h LEFT JOIN (SELECT u.dst AS id, j AS o, sum(al * r) AS v FROM u JOIN al USING (k) GROUP BY 1, 2) f USING (id, o))",
    "o AS MATERIALIZED (SELECT id, m.o, sum(v * w) AS v FROM c JOIN w_0_out_weight m ON m.i = c.j GROUP BY 1, 2)",
    "st AS (SELECT o, avg(v) AS mean, 1 / sqrt(var_pop(v) + 1e-5) AS f FROM o GROUP BY 1)", "y AS MATERIALIZED (SELECT id, o, (v - mean) * f AS v, f FROM o JOIN st USING (o))",
    "x1 AS MATERIALIZED (SELECT id, o, y.v * ga.w + be.w + h.v AS v FROM y JOIN h USING (id, o) JOIN w_0_gamma ga USING (o) JOIN w_0_beta be USING (o))",
    "lg AS (SELECT id, m.o AS c, sum(v * m.w) + any_value(b.w) AS l FROM x1 JOIN w_head_weight m ON m.i = x1.o JOIN w_head_bias b ON b.o = m.o GROUP BY 1, 2)",
    "gl AS MATERIALIZED (SELECT id, c, (e / sum(e) OVER (PARTITION BY id) - (y = c)::INT) / (SELECT count(*) FROM nodes WHERE split = 'train' AND y IS NOT NULL) AS g FROM (SELECT lg.id, c, exp(l - max(l) OVER (PARTITION BY lg.id)) AS e, y FROM lg JOIN nodes n ON n.id = lg.id AND split = 'train' AND y IS NOT NULL))",
    "gx AS MATERIALIZED (SELECT x1.id, x1.o, coalesce(f.g, 0) AS g FROM x1 LEFT JOIN (SELECT id, m.i AS o, sum(g * w) AS g FROM gl JOIN w_head_weight m ON m.o = gl.c GROUP BY 1, 2) f USING (id, o))",
    "gy AS MATERIALIZED (SELECT id, o, g * w AS g, y.v, f FROM gx JOIN y USING (id, o) JOIN w_0_gamma USING (o))", "mg AS (SELECT o, avg(g) AS a, avg(g * v) AS b FROM gy GROUP BY 1)",
    "go AS MATERIALIZED (SELECT id, o, f * (g - a - v * b) AS g FROM gy JOIN mg USING (o))",
    "gc AS MATERIALIZED (SELECT id, m.i AS j, sum(g * w) AS g FROM go JOIN w_0_out_weight m USING (o) GROUP BY 1, 2)",
    "ds AS MATERIALIZED (SELECT k, al, al * (p - sum(al * p) OVER (PARTITION BY dst)) AS ds FROM (SELECT u.k, u.dst, any_value(al) AS al, sum(g * r) AS p FROM u JOIN gc ON gc.id = u.dst AND gc.j = u.j JOIN al ON al.k = u.k GROUP BY 1, 2))",
    "du AS MATERIALIZED (SELECT u.*, al, ds, ds * att * CASE WHEN u > 0 THEN 1 ELSE 0.2 END AS d FROM u JOIN ds USING (k))",
    "g_left AS MATERIALIZED (SELECT dst AS id, j, sum(d) AS g FROM du GROUP BY 1, 2)", "g_right AS MATERIALIZED (SELECT src AS id, du.j, sum(al * g + d) AS g FROM du JOIN gc ON gc.id = dst AND gc.j = du.j GROUP BY 1, 2)",
    "gh AS MATERIALIZED (SELECT id, o, sum(g) AS g FROM (SELECT id, o, g FROM gx UNION ALL SELECT id, m.i, g * w FROM g_left a JOIN w_0_left_weight m ON m.o = a.j UNION ALL SELECT id, m.i, g * w FROM g_right a JOIN w_0_right_weight m ON m.o = a.j) GROUP BY 1, 2)",
    "gz AS MATERIALIZED (SELECT id, o, CASE WHEN v > 0 THEN g ELSE g * w END AS g, CASE WHEN v > 0 THEN 0 ELSE g * v END AS ga FROM gh JOIN z USING (id, o) JOIN w_0_alpha USING (o))",
])
STEP_PARTS = {
    "0.weight": "o, i, g * v FROM gz JOIN nx USING (id)", "0.bias": "o, 0, g FROM gz", "0.alpha": "o, 0, ga FROM gz",
    "0.left.weight": "j, o, g * v FROM g_left JOIN h USING (id)", "0.right.weight": "j, o, g * v FROM g_right JOIN h USING (id)",
    "0.attn": "0, j, ds * CASE WHEN u > 0 THEN u ELSE 0.2 * u END FROM du", "0.out.weight": "o, j, g * v FROM go JOIN c USING (id)",
    "0.gamma": "o, 0, g * y.v FROM gx JOIN y USING (id, o)", "0.beta": "o, 0, g FROM gx", "head.weight": "c, o, g * v FROM gl JOIN x1 USING (id)", "head.bias": "c, 0, g FROM gl",
}


@query(ATTENTION_STEP + " " + " UNION ALL ".join(f"SELECT '{name}' AS weight, o::BIGINT AS o, i::BIGINT AS i, {rsql('sum(g)', 5)} AS value FROM (SELECT {rows}) t(o, i, g) GROUP BY 2, 3" for name, rows in STEP_PARTS.items()))
def attention_gradients(s, d):
    """Gradients of every weight of a GATv2 block with projections, learned slopes and batch normalisation, and of its head."""
    _, grads, _ = training.gradients(labelled_vectors(s, d), vector_edges(s, d), STEP)
    rows = [(name, o, i, float(v)) for name, g in grads.items() for o, row in enumerate(g if g.ndim > 1 else g[:, None]) for i, v in enumerate(row)]
    return s.createDataFrame(rows, "weight string, o long, i long, value double").withColumn("value", rounded(F.col("value"), 5))


def labelled_vectors(s, d):
    return vectors(s, d).withColumn("split", F.when(F.col("id") % 5 < 3, "train").when(F.col("id") % 5 == 3, "val").otherwise("test"))


@query()
def fit_classifier(s, d):
    n = vectors(s, d).withColumn("split", F.when(F.col("id") % 5 < 3, "train").when(F.col("id") % 5 == 3, "val").otherwise("test"))
    got = nn.fit(n, vector_edges(s, d), 10, hops=1, conv="mean", epochs=6, lr=0.2, check_every=2)
    return s.createDataFrame([(r["epoch"], float(r["loss"]), float(r["train_accuracy"]), None if r["val_accuracy"] is None else float(r["val_accuracy"])) for r in got.history], "epoch long, loss double, train_accuracy double, val_accuracy double")


@query(f"WITH {VECTORS}, z AS (SELECT y, list_transform(x, lambda v: v * 4) AS l FROM nodes) SELECT {rsql('avg(ln(list_sum(list_transform(l, lambda v: exp(v)))) - l[y + 1])', 5)} AS loss FROM z")
def cross_entropy(s, d):
    n = vectors(s, d).withColumn("logits", F.transform("x", lambda v: v * 4))  # 64 classes, of which ten occur
    return nn.softmax_xent(n).withColumn("loss", rounded(F.col("loss"), 5))


# ---- feature preparation: customers as raw rows, with gaps ---------------------------------------------------------------

RAW = "raw AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 4 THEN NULL ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 7 = 2 THEN NULL ELSE c_nationkey % 6 END::DOUBLE AS nat, (c_custkey * 37 % 101) / 100.0 AS frac, c_mktsegment AS seg, c_custkey % 2 AS two, CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_acctbal + c_custkey END AS y, CASE WHEN c_custkey % 5 < 3 THEN 'train' WHEN c_custkey % 5 = 3 THEN 'val' ELSE 'test' END AS split FROM customer)"


def raw(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(
        k.alias("id"), F.when(k % 9 != 4, F.col("c_acctbal")).alias("bal"), F.when(k % 7 != 2, (F.col("c_nationkey") % 6).cast("double")).alias("nat"), ((k * 37 % 101) / 100.0).alias("frac"),
        F.col("c_mktsegment").alias("seg"), (k % 2).alias("two"), F.when(k % 10 != 3, F.col("c_acctbal") + k).alias("y"), F.when(k % 5 < 3, "train").when(k % 5 == 3, "val").otherwise("test").alias("split"),
    )


@query(f"WITH {RAW} SELECT id, {rsql('coalesce(bal, (SELECT avg(bal) FROM raw))')} AS by_mean, {rsql('coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM raw))')} AS by_median, coalesce(nat, (SELECT nat FROM raw WHERE nat IS NOT NULL GROUP BY nat ORDER BY count(*) DESC, nat LIMIT 1)) AS by_mode FROM raw")
def imputed(s, d):
    r = raw(s, d)
    one = lambda c, how, n: prepare.impute(r, prepare.fit_impute(r, [c], how)).select("id", F.col(c).alias(n))
    a, b, c = one("bal", "mean", "by_mean"), one("bal", "median", "by_median"), one("nat", "most_frequent", "by_mode")
    return a.join(b, "id").join(c, "id").withColumn("by_mean", rounded(F.col("by_mean"))).withColumn("by_median", rounded(F.col("by_median")))


@query(f"WITH {RAW} SELECT id, {rsql('(bal - (SELECT avg(bal) FROM raw)) / (SELECT stddev_pop(bal) FROM raw)')} AS standard, {rsql('(bal - (SELECT min(bal) FROM raw)) / (SELECT max(bal) - min(bal) FROM raw)')} AS min_max, {rsql('''(y - (SELECT avg(y) FROM raw WHERE split = 'train')) / (SELECT stddev_pop(y) FROM raw WHERE split = 'train')''')} AS target FROM raw")
def scaled(s, d):
    r = raw(s, d).withColumn("b2", F.col("bal"))
    r = prepare.scale(r, prepare.fit_scale(r, ["bal"], "standard"))
    r = prepare.scale(r, prepare.fit_scale(raw(s, d).withColumn("b2", F.col("bal")), ["b2"], "min_max"))
    r = prepare.scale(r, prepare.fit_scale(raw(s, d).where("split = 'train'"), ["y"], "standard"))
    return r.select("id", rounded(F.col("bal")).alias("standard"), rounded(F.col("b2")).alias("min_max"), rounded(F.col("y")).alias("target"))


QUANTILE = f"WITH {RAW}, q AS (SELECT unnest(range(21)) AS k, unnest(quantile_cont({{c}}, [{', '.join(str(i / 20) for i in range(21))}])) AS v FROM raw), b AS (SELECT r.id, r.{{c}} AS x, sum((q.v < r.{{c}})::INT) AS lt, sum((q.v <= r.{{c}})::INT) AS le FROM raw r, q GROUP BY 1, 2) SELECT id, {{r}} AS value FROM (SELECT id, CASE WHEN x IS NULL THEN NULL WHEN x <= (SELECT min(v) FROM q) THEN 0.0 WHEN x >= (SELECT max(v) FROM q) THEN 1.0 WHEN le > lt THEN (lt + le - 1) / 40.0 ELSE (lt - 1 + (x - (SELECT v FROM q WHERE k = lt - 1)) / ((SELECT v FROM q WHERE k = lt) - (SELECT v FROM q WHERE k = lt - 1))) / 20.0 END AS u FROM b)"


def quantiled(c):
    def run(s, d):
        r = raw(s, d)
        out = prepare.quantile_transform(r, prepare.fit_quantiles(r, [c], 21))
        return out.select("id", rounded(F.col(c)).alias("value"))

    run.__name__ = f"quantile_uniform_{c}"
    query(QUANTILE.format(c=c, r=rsql("u")))(run)


quantiled("bal")
quantiled("nat")  # many ties


def poly(x: str, values: tuple[float, ...]) -> str:
    out = repr(values[0])
    for v in values[1:]:
        out = f"({out} * {x} + {v!r})"
    return out


NORMAL = f"SELECT *, p - 0.5 AS h, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM (SELECT id, CASE WHEN u IS NULL THEN NULL ELSE greatest(1e-7, least(u, 1 - 1e-7)) END AS p FROM ({QUANTILE.split('SELECT id, {r} AS value FROM ')[1]}))"
NORMAL_VALUE = f"CASE WHEN p BETWEEN 0.02425 AND 0.97575 THEN {poly('(h * h)', V._A)} * h / {poly('(h * h)', V._B)} WHEN p < 0.5 THEN {poly('t', V._C)} / {poly('t', V._D)} ELSE -{poly('t', V._C)} / {poly('t', V._D)} END"


@query(QUANTILE.split("SELECT id, {r} AS value FROM ")[0].format(c="bal") + f" SELECT id, {rsql(NORMAL_VALUE, 5)} AS value FROM ({NORMAL.format(c='bal', r='')})")
def quantile_normal(s, d):
    r = raw(s, d)
    return prepare.quantile_transform(r, prepare.fit_quantiles(r, ["bal"], 21), "normal").select("id", rounded(F.col("bal"), 5).alias("value"))


@query(f"WITH {RAW}, c AS (SELECT DISTINCT seg FROM raw), k AS (SELECT seg AS cat, row_number() OVER (ORDER BY seg) - 1 AS slot FROM c) SELECT id, slot, (seg = cat)::INT::DOUBLE AS value FROM raw, k UNION ALL SELECT id, (SELECT count(*) FROM k) AS slot, two::DOUBLE FROM raw")
def one_hot(s, d):
    r = raw(s, d)
    found = prepare.fit_one_hot(r, ["seg", "two"])
    x, _ = prepare.feature_vector([], [], found)
    return r.select("id", F.posexplode(x).alias("slot", "value")).withColumn("slot", F.col("slot").cast("long"))


TRAIN = "(SELECT * FROM raw WHERE split = 'train' AND y IS NOT NULL)"
QB = f"(SELECT quantile_cont(y, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) FROM {TRAIN})"


@query(f"WITH {RAW}, q AS (SELECT list_sort(list_distinct({QB})) AS e), u AS (SELECT min(y) AS lo, max(y) AS hi FROM {TRAIN}) SELECT id, (CASE WHEN y IS NULL THEN NULL ELSE greatest(0, least(len(e) - 2, len(list_filter(e[2:len(e) - 1], lambda v: v <= y)))) END)::BIGINT AS by_quantile, (CASE WHEN y IS NULL THEN NULL ELSE greatest(0, least(3, (y >= lo + (hi - lo) / 4)::INT + (y >= lo + (hi - lo) * 2 / 4)::INT + (y >= lo + (hi - lo) * 3 / 4)::INT)) END)::BIGINT AS by_width FROM raw, q, u")
def binned_target(s, d):
    r = raw(s, d)
    train = r.where("split = 'train' and y is not null")
    return r.select("id", prepare.bin_target(F.col("y"), prepare.fit_bins(train, "y", "quantile", 5)).alias("by_quantile"), prepare.bin_target(F.col("y"), prepare.fit_bins(train, "y", "uniform", 4)).alias("by_width"))


@query("WITH n AS (SELECT count(*) AS n FROM customer) SELECT 'train' AS split, (n * 6 // 10)::BIGINT AS n FROM n UNION ALL SELECT 'val', (n * 2 // 10)::BIGINT FROM n UNION ALL SELECT 'test', (n - n * 6 // 10 - n * 2 // 10)::BIGINT FROM n")
def random_split(s, d):
    return prepare.random_split(raw(s, d).drop("split"), 7).groupBy("split").agg(F.count("*").alias("n"))


SNAP = f"WITH {RAW}, e AS (SELECT o_custkey AS src, (o_custkey * 31 + o_orderkey) % (SELECT count(*) FROM customer) AS dst FROM orders)"
SNAP_ONE = "SELECT '{n}' AS snapshot, (SELECT count(*) FROM raw WHERE {k}) AS n_nodes, (SELECT count(*) FROM e JOIN raw a ON a.id = src JOIN raw b ON b.id = dst WHERE a.{k} AND b.{k}) AS n_edges, (SELECT count(*) FROM raw WHERE split = '{n}' AND y IS NOT NULL) AS n_labelled, (SELECT sum(id) FROM raw WHERE {k})::BIGINT AS ids"


def raw_edges(s, d):
    n = table(s, d, "customer").count()
    return table(s, d, "orders").select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 31 + F.col("o_orderkey")) % n).alias("dst"))


@query(SNAP + " " + " UNION ALL ".join(SNAP_ONE.format(n=n, k=k) for n, k in (("train", "split IN ('train')"), ("val", "split IN ('train', 'val')"), ("test", "split IS NOT NULL"))))
def inductive_snapshots(s, d):
    out = None
    for name, (n, e, ids) in prepare.snapshots(raw(s, d), raw_edges(s, d)).items():
        one = n.agg(F.count("*").alias("n_nodes"), F.sum(F.col("label_mask").cast("long")).alias("n_labelled")).join(F.broadcast(e.agg(F.count("*").alias("n_edges")))).join(F.broadcast(ids.agg(F.sum("node_id").alias("ids"))))  # one row each
        one = one.select(F.lit(name).alias("snapshot"), "n_nodes", "n_edges", "n_labelled", "ids")
        out = one if out is None else out.unionByName(one)
    return out


def bundle(s, d):
    return io.Bundle(raw(s, d), raw_edges(s, d), ["bal", "nat"], ["frac"], ["seg", "two"], "regression")


@query(f"WITH {RAW}, f AS (SELECT id, coalesce(bal, (SELECT avg(bal) FROM raw)) AS bal, coalesce(nat, (SELECT avg(nat) FROM raw)) AS nat, frac, seg, two FROM raw), c AS (SELECT seg AS cat, row_number() OVER (ORDER BY seg) + 2 AS slot FROM (SELECT DISTINCT seg FROM raw)) SELECT id, slot, {rsql('v')} AS value FROM (SELECT id, 0 AS slot, (bal - (SELECT avg(bal) FROM raw)) / (SELECT stddev_pop(bal) FROM raw) AS v FROM f UNION ALL SELECT id, 1, (nat - (SELECT avg(nat) FROM raw)) / (SELECT stddev_pop(nat) FROM raw) FROM f UNION ALL SELECT id, 2, frac FROM f UNION ALL SELECT id, slot, (seg = cat)::INT::DOUBLE FROM f, c UNION ALL SELECT id, 3 + (SELECT count(*) FROM c), two::DOUBLE FROM f)")
def prepared_dataset(s, d):
    p = flows.prepare_dataset(bundle(s, d), "standard", "mean")
    return long(p.nodes.withColumnRenamed("x", "out"))


@query(f"WITH {RAW} SELECT count(*)::BIGINT AS n_nodes, 0::BIGINT AS n_repeated, 0::BIGINT AS n_length, 0::BIGINT AS n_missing, 0::BIGINT AS n_overlapping, 0::BIGINT AS n_unlabelled, true AS ok FROM raw")
def dataset_check(s, d):
    p = flows.prepare_dataset(bundle(s, d), "quantile_normal", "median", bins=("quantile", 5))
    nodes = p.nodes.withColumns({k: F.col("split") == k for k in ("train", "val", "test")})
    return prepare.check_dataset(nodes, p.kinds, "y", ["train", "val", "test"], "label_mask")


@query(f"WITH {RAW} SELECT count(*)::BIGINT AS n_nodes, 0::BIGINT AS n_repeated, sum((id % 3 = 0)::INT)::BIGINT AS n_length, sum((id % 4 = 0)::INT)::BIGINT AS n_missing, sum((id % 6 = 0)::INT)::BIGINT AS n_overlapping, sum((id % 2 = 0 AND y IS NULL)::INT)::BIGINT AS n_unlabelled, false AS ok FROM raw")
def broken_dataset_check(s, d):
    """Rows whose features, masks and labels are broken by their ids."""
    k = F.col("id")
    x = F.when(k % 3 == 0, F.array(F.when(k % 4 != 0, 1.0))).otherwise(F.array(F.when(k % 4 != 0, 1.0), F.lit(2.0)))
    rows = raw(s, d).select("id", "y", x.alias("x"), (k % 2 == 0).alias("a"), (k % 3 == 0).alias("b"))
    return prepare.check_dataset(rows, ["num", "num"], "y", ["a", "b"], "a")


@query(SNAP + " " + " UNION ALL ".join(f"SELECT snapshot, n_nodes, n_edges, 0::BIGINT AS n_loose, n_labelled, true AS ok FROM ({SNAP_ONE.format(n=n, k=k)})" for n, k in (("train", "split IN ('train')"), ("val", "split IN ('train', 'val')"), ("test", "split IS NOT NULL"))))
def snapshot_check(s, d):
    return prepare.check_snapshots(prepare.snapshots(raw(s, d), raw_edges(s, d)), raw(s, d), raw_edges(s, d))


@query(f"WITH {RAW} SELECT id, CASE WHEN id % 3 = 0 AND bal > 0 THEN 'train' WHEN id % 3 = 1 THEN 'val' END AS split FROM raw")
def index_split(s, d):
    r = raw(s, d)
    return prepare.index_split(r.select("id"), {"train": r.where("id % 3 = 0 and bal > 0"), "val": r.where("id % 3 = 1")})


@query(f"WITH {RAW} SELECT id, bal > 0 IS TRUE AS train, id % 3 = 1 AS val, id % 4 = 0 AS test FROM raw")
def index_masks(s, d):
    """Lists that overlap, one of them with every id twice."""
    r = raw(s, d)
    return prepare.index_masks(r.select("id"), {"train": r.where("bal > 0"), "val": r.where("id % 3 = 1").unionByName(r.where("id % 3 = 1")), "test": r.where("id % 4 = 0")})


@query(f"WITH {RAW} SELECT split, count(*)::BIGINT AS n, {rsql('avg(y)')} AS mean_y FROM raw WHERE split <> 'test' AND y IS NOT NULL GROUP BY 1")
def labelled_rows(s, d):
    rows = metrics.labelled(raw(s, d), F.col("split") != "test")
    return rows.groupBy("split").agg(F.count("*").alias("n"), rounded(F.avg("y")).alias("mean_y"))


# ---- metrics: labels of documents, and classes of vectors -----------------------------------------------------------------

PRED = "p AS (SELECT doc_id AS id, quality::BIGINT AS y, toxic::BIGINT AS pred, (doc_id * 37 % 101) / 100.0 + quality * 0.1 AS score, doc_id % 5 AS epoch, doc_id % 20 AS batch FROM labels)"


def predictions(s, d):
    k = F.col("doc_id")
    return table(s, d, "labels").select(k.alias("id"), F.col("quality").cast("long").alias("y"), F.col("toxic").cast("long").alias("pred"), ((k * 37 % 101) / 100.0 + F.col("quality") * 0.1).alias("score"), (k % 5).alias("epoch"), (k % 20).alias("batch"))


@query(f"WITH {PRED}, c AS (SELECT l AS label, sum((y = l AND pred = l)::INT) AS tp, sum((y <> l AND pred = l)::INT) AS fp, sum((y = l AND pred <> l)::INT) AS fn FROM p, (SELECT y AS l FROM p UNION SELECT pred FROM p) GROUP BY 1), f AS (SELECT *, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f FROM c) SELECT (SELECT {rsql('avg((y = pred)::INT)')} FROM p) AS accuracy, {rsql('avg(coalesce(f, 0))')} AS f1_macro, {rsql('2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))')} AS f1_micro, {rsql('sum(coalesce(f, 0) * (tp + fn)) / sum(tp + fn)')} AS f1_weighted, (SELECT {rsql('coalesce(tp / nullif(tp + fp, 0), 0)')} FROM c WHERE label = 1) AS \"precision\", (SELECT {rsql('coalesce(tp / nullif(tp + fn, 0), 0)')} FROM c WHERE label = 1) AS recall FROM f")
def classification_metrics(s, d):
    p = predictions(s, d)
    out = metrics.accuracy(p)
    for a in ("macro", "micro", "weighted"):
        out = out.join(F.broadcast(metrics.f1(p, a).withColumnRenamed("f1", f"f1_{a}")))  # one row each
    out = out.join(F.broadcast(metrics.precision_recall(p)))
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


@query(f"WITH {PRED}, r AS (SELECT y, avg(k) OVER (PARTITION BY score) AS rk FROM (SELECT y, score, row_number() OVER (ORDER BY score) AS k FROM p)), a AS (SELECT sum(y) AS np, sum(1 - y) AS nn, sum(CASE WHEN y = 1 THEN rk END) AS sr FROM r) SELECT {rsql('(sr - np * (np + 1) / 2.0) / (np * nn)')} AS auc FROM a")
def roc_auc(s, d):
    return metrics.auc(predictions(s, d)).select(rounded(F.col("auc")).alias("auc"))


@query(f"WITH {VECTORS}, z AS (SELECT id, y, unnest(range(10)) AS c, unnest(x[1:10]) AS v FROM nodes), e AS (SELECT id, (y = c)::INT AS y, c, round(exp(v) / sum(exp(v)) OVER (PARTITION BY id), 12) AS score FROM z), r AS (SELECT c, y, avg(k) OVER (PARTITION BY c, score) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score) AS k FROM e)), a AS (SELECT c, sum(y) AS np, sum(1 - y) AS nn, sum(CASE WHEN y = 1 THEN rk END) AS sr FROM r GROUP BY 1) SELECT {rsql('avg(CASE WHEN np * nn > 0 THEN (sr - np * (np + 1) / 2.0) / (np * nn) ELSE 0.5 END)')} AS auc FROM a")
def multiclass_auc(s, d):
    n = vectors(s, d).withColumn("logits", F.slice("x", 1, 10))
    return metrics.multiclass_auc(n).select(rounded(F.col("auc")).alias("auc"))


@query(f"WITH r AS (SELECT l_extendedprice / 1000 AS y, l_quantity * 1.5 AS pred FROM lineitem) SELECT {rsql('avg((y - pred) * (y - pred))')} AS mse, {rsql('avg(abs(y - pred))')} AS mae, {rsql('1 - sum((y - pred) * (y - pred)) / (SELECT var_pop(y) * count(*) FROM r)')} AS r2 FROM r")
def regression_metrics(s, d):
    m = metrics.regression(table(s, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("pred")))
    return m.select(*[rounded(F.col(c)).alias(c) for c in m.columns])


@query(f"WITH {PRED}, l AS (SELECT epoch, batch, (epoch + 1) / (batch + 2.0) AS loss FROM p GROUP BY 1, 2) SELECT p.epoch, any_value(x.loss) AS loss, {rsql('avg((y = pred)::INT)')} AS accuracy FROM p JOIN (SELECT epoch, {rsql('avg(loss)')} AS loss FROM l GROUP BY 1) x ON x.epoch = p.epoch GROUP BY 1")
def epoch_metrics(s, d):
    m = metrics.epoch_metrics(predictions(s, d).withColumn("loss", (F.col("epoch") + 1) / (F.col("batch") + 2.0)))
    return m.select("epoch", rounded(F.col("loss")).alias("loss"), rounded(F.col("accuracy")).alias("accuracy"))


HISTORY = "h AS (SELECT doc_id % 50 AS epoch, round(avg(toxic) + 0.001 * (doc_id % 50), 6) AS value FROM labels GROUP BY 1)"


@query(f"WITH {HISTORY}, n AS (SELECT *, row_number() OVER (ORDER BY epoch) AS n, coalesce(value > max(value) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM h), g AS (SELECT *, n - max(CASE WHEN new THEN n END) OVER (ORDER BY epoch) AS since FROM n), s AS (SELECT min(epoch) AS stop_epoch FROM g WHERE since >= 4) SELECT epoch AS best_epoch, value AS best_value, stop_epoch FROM g, s WHERE new AND (stop_epoch IS NULL OR epoch <= stop_epoch) ORDER BY epoch DESC LIMIT 1")
def early_stop(s, d):
    h = table(s, d, "labels").groupBy((F.col("doc_id") % 50).alias("epoch")).agg(F.avg("toxic").alias("v"))
    return metrics.early_stop(h.select("epoch", F.round(F.col("v") + 0.001 * F.col("epoch"), 6).alias("value")), 4)


# ---- reports: events as measurements ------------------------------------------------------------------------------------

BACKENDS = ["click", "error", "purchase", "signup", "view"]
RUNS = "m AS (SELECT event_id AS run_id, event_type AS backend, 'd' || (user_id % 7) AS dataset, 'c' || (user_id % 3) AS conv_type, (32 * (1 + event_id % 2))::BIGINT AS feature_dim, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS heads, CASE WHEN event_id % 4 = 0 THEN -1 ELSE 16 * (event_id % 4) END AS graph_reordering_partition_size, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS forward_ms, value * 1.5 + event_id % 5 AS backward_ms, value + 10 AS forward_memory_mb, 2 * value + 1 AS backward_memory_mb, (100 + user_id % 7)::BIGINT AS num_nodes, (500 * (1 + user_id % 7))::BIGINT AS num_edges FROM events)"
RUNS += ", r AS (SELECT *, forward_ms + backward_ms AS total_ms FROM m)"
SETUP_SQL = "conv_type, dataset, feature_dim, heads, graph_reordering_partition_size"


def runs(s, d):
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    return report.derived(table(s, d, "events").select(
        e.alias("run_id"), F.col("event_type").alias("backend"), F.concat(F.lit("d"), u % 7).alias("dataset"), F.concat(F.lit("c"), u % 3).alias("conv_type"), (32 * (1 + e % 2)).cast("long").alias("feature_dim"),
        F.when(e % 3 > 0, e % 3).alias("heads"), F.when(e % 4 == 0, F.lit(-1).cast("long")).otherwise(16 * (e % 4)).alias("graph_reordering_partition_size"), F.when(e % 11 != 0, v).alias("forward_ms"), (v * 1.5 + e % 5).alias("backward_ms"),
        (v + 10).alias("forward_memory_mb"), (2 * v + 1).alias("backward_memory_mb"), (100 + u % 7).cast("long").alias("num_nodes"), (500 * (1 + u % 7)).cast("long").alias("num_edges"),
    ))


BASE = f"b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {SETUP_SQL} ORDER BY run_id) AS k FROM r WHERE backend = 'click' AND {{have}}) WHERE k = 1)"


def up_sql(m: str) -> str:
    return f"CASE WHEN b.{m} > 0 AND r.{m} > 0 THEN b.{m} / r.{m} END"


JOINED = "r LEFT JOIN b ON " + " AND ".join(f"r.{c} IS NOT DISTINCT FROM b.{c}" for c in SETUP_SQL.split(", "))


@query(f"WITH {RUNS}, {BASE.format(have='true')} SELECT r.run_id, {rsql(up_sql('backward_ms'), 5)} AS backward_ms_speedup, {rsql(up_sql('forward_memory_mb'), 5)} AS forward_memory_mb_speedup FROM {JOINED}")
def speedup(s, d):
    m = ["backward_ms", "forward_memory_mb"]
    return report.speedup(runs(s, d), "click", measures=m).select("run_id", *[rounded(F.col(f"{c}_speedup"), 5).alias(f"{c}_speedup") for c in m])


PIVOT = f"WITH {RUNS}, {BASE.format(have='true')}, u AS (SELECT r.*, {up_sql('backward_ms')} AS up FROM {JOINED})"


@query(f"{PIVOT} SELECT {SETUP_SQL}, " + ", ".join(f"{rsql(f'''max(CASE WHEN backend = '{b}' THEN up END)''', 5)} AS {b}" for b in BACKENDS[1:]) + f" FROM u GROUP BY {SETUP_SQL}")
def speedup_table(s, d):
    t = report.speedup_table(runs(s, d), "click", BACKENDS, "backward_ms")
    return t.select(*report.SETUP, *[rounded(F.col(b), 5).alias(b) for b in BACKENDS[1:]])


@query(f"WITH {RUNS} SELECT {SETUP_SQL}, " + ", ".join(f"min(CASE WHEN backend = '{b}' THEN backward_ms END) AS {b}" for b in BACKENDS) + f" FROM r GROUP BY {SETUP_SQL}")
def raw_table(s, d):
    return report.raw_table(runs(s, d), BACKENDS, "backward_ms")


@query(f"{PIVOT}, t AS (SELECT {SETUP_SQL}, backend, max(up) AS v FROM u WHERE backend <> 'click' GROUP BY ALL) SELECT backend, {rsql('exp(avg(CASE WHEN v > 0 THEN ln(v) END))', 5)} AS gmean FROM t GROUP BY 1")
def gmean_speedup(s, d):
    t = report.to_long(report.speedup_table(runs(s, d), "click", BACKENDS, "backward_ms"), report.SETUP)
    return report.gmean_speedup(t, ["backend"]).withColumn("gmean", rounded(F.col("gmean"), 5))


@query(f"WITH {RUNS} SELECT conv_type, heads, feature_dim, dataset, " + ", ".join(f"arg_min(backward_ms, run_id) FILTER (WHERE backend = '{b}') AS {b}" for b in BACKENDS) + " FROM r GROUP BY 1, 2, 3, 4")
def setup_tables(s, d):
    return report.setup_tables(runs(s, d), BACKENDS, "backward_ms")


LEVEL = "a AS (SELECT dataset, feature_dim, graph_reordering_partition_size AS size, max(backward_ms) AS ms FROM r GROUP BY 1, 2, 3)"


@query(f"WITH {RUNS}, {LEVEL} SELECT a.*, {rsql('a.ms / x.ms')} AS ratio FROM a LEFT JOIN a x ON x.dataset = a.dataset AND x.feature_dim = a.feature_dim AND x.size = -1")
def ratio_to_level(s, d):
    a = runs(s, d).groupBy("dataset", "feature_dim", F.col("graph_reordering_partition_size").alias("size")).agg(F.max("backward_ms").alias("ms"))
    out = report.ratio_to_level(a, ["dataset", "feature_dim"], "size", -1, "ms")
    return out.withColumn("ratio", rounded(F.col("ratio")))


DIFF = "v AS (SELECT dataset, graph_reordering_partition_size AS size, avg(CASE WHEN run_id % 2 = 0 THEN backward_ms END) AS a, avg(CASE WHEN run_id % 2 = 1 THEN backward_ms END) AS b FROM r GROUP BY 1, 2)"


def variants(s, d):
    r = runs(s, d).withColumn("kind", F.col("run_id") % 2).withColumnRenamed("graph_reordering_partition_size", "size")
    return report.variant_diff(r.withColumn("kind", report.relabel(F.col("kind"), {0: "plain", 1: "mixed"})), ["dataset", "size"], "kind", "plain", "mixed", "backward_ms")


@query(f"WITH {RUNS}, {DIFF} SELECT dataset, size, {rsql('a')} AS value_a, {rsql('b')} AS value_b, {rsql('b - a')} AS diff, {rsql('b / a')} AS ratio, {rsql('(b - a) * 100 / a')} AS percent FROM v")
def variant_diff(s, d):
    v = variants(s, d)
    return v.select("dataset", "size", *[rounded(F.col(c)).alias(c) for c in ("value_a", "value_b", "diff", "ratio", "percent")])


@query(f"WITH {RUNS}, {DIFF} SELECT dataset, size, 'diff' AS metric, {rsql('a - b')} AS value FROM v WHERE size <> -1 UNION ALL SELECT dataset, size, 'percent', {rsql('-((b - a) * 100 / a)')} FROM v WHERE size <> -1")
def melted_diff(s, d):
    v = variants(s, d).select("dataset", "size", "diff", "percent")
    return report.melt_diff(v, ["dataset"], "size", -1).withColumn("value", rounded(F.col("value")))


@query(f"WITH {RUNS}, q AS (SELECT dataset, feature_dim, quantile_cont(backward_ms, 0.25) AS q1, quantile_cont(backward_ms, 0.5) AS median, quantile_cont(backward_ms, 0.75) AS q3 FROM r GROUP BY 1, 2), x AS (SELECT r.dataset, r.feature_dim, q1, median, q3, backward_ms AS v, backward_ms BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM r JOIN q USING (dataset, feature_dim)) SELECT dataset, feature_dim, {rsql('q1')} AS q1, {rsql('median')} AS median, {rsql('q3')} AS q3, {rsql('min(CASE WHEN ok THEN v END)')} AS low, {rsql('max(CASE WHEN ok THEN v END)')} AS high, sum((NOT ok)::INT)::BIGINT AS outliers FROM x GROUP BY dataset, feature_dim, x.q1, x.median, x.q3")
def box_stats(s, d):
    b = report.box_stats(runs(s, d), ["dataset", "feature_dim"], "backward_ms")
    return b.select("dataset", "feature_dim", *[rounded(F.col(c)).alias(c) for c in ("q1", "median", "q3", "low", "high")], "outliers")


@query(f"WITH {RUNS}, k AS (SELECT dataset, backend, feature_dim, avg(CASE WHEN run_id % 4 < 2 THEN backward_ms END) AS o, avg(CASE WHEN run_id % 4 >= 2 THEN backward_ms END) AS n FROM r GROUP BY 1, 2, 3) SELECT dataset, {rsql('avg(n - o)')} AS mean_diff, {rsql('avg((n - o) / o)')} AS mean_relative FROM k GROUP BY 1")
def compared_runs(s, d):
    keys = ["dataset", "backend", "feature_dim"]
    half = lambda c: runs(s, d).where(c).groupBy(*keys).agg(F.avg("backward_ms").alias("ms"))
    m = report.mean_by_dataset(report.compare_runs(half("run_id % 4 < 2"), half("run_id % 4 >= 2"), keys, "ms"))
    return m.select("dataset", rounded(F.col("mean_diff")).alias("mean_diff"), rounded(F.col("mean_relative")).alias("mean_relative"))


@query(f"WITH {RUNS} SELECT dataset, feature_dim, " + ", ".join(f"{rsql(f'''avg(CASE WHEN backend = '{b}' THEN {m} END)''')} AS {b}_{m}" for b in BACKENDS for m in ("forward_ms", "total_ms")) + " FROM r GROUP BY 1, 2")
def backend_pivot(s, d):
    p = report.backend_pivot(runs(s, d), ["dataset", "feature_dim"], BACKENDS, ["forward_ms", "total_ms"])
    return p.select("dataset", "feature_dim", *[rounded(F.col(c)).alias(c) for c in p.columns if c not in ("dataset", "feature_dim")])


@query(f"WITH {RUNS} SELECT dataset, backend, feature_dim, heads, backward_ms FROM (SELECT *, row_number() OVER (PARTITION BY dataset, backend ORDER BY backward_ms, run_id) AS k FROM r) WHERE k = 1")
def best_config(s, d):
    return report.best_config(runs(s, d), ["dataset", "backend"], ["feature_dim", "heads"], "backward_ms")


@query(f"WITH {RUNS}, g AS (SELECT dataset, max(num_nodes) AS num_nodes, max(num_edges) AS num_edges FROM r GROUP BY 1) SELECT *, {rsql('num_edges / num_nodes / (num_nodes - 1)', 9)} AS density, {rsql('num_edges / num_nodes')} AS average_degree FROM g")
def graph_summary(s, d):
    from .operators.graph import graph_summary as summary

    return summary(runs(s, d)).withColumn("density", rounded(F.col("density"), 9)).withColumn("average_degree", rounded(F.col("average_degree")))


@query(f"WITH {RUNS} SELECT run_id, backend, heads FROM r WHERE backend IN ('click', 'view') AND dataset <> 'd3' AND forward_ms > 0")
def filtered_runs(s, d):
    r = report.allowed(report.allowed(runs(s, d), "backend", ["click", "view"]), "dataset", deny=["d3"])
    # precision is one value in all rows, so it goes with the constant columns
    r = report.drop_constant_columns(r.where(report.finite(F.col("forward_ms")) & (F.col("forward_ms") > 0)).withColumn("precision", F.lit("fp32")))
    assert "precision" not in r.columns
    return r.select("run_id", "backend", "heads")


@query(f"WITH {RUNS} SELECT dataset, run_id, {rsql('max(forward_ms) OVER (PARTITION BY dataset ORDER BY run_id)')} AS best FROM r")
def running_best(s, d):
    return report.running_best(runs(s, d), ["dataset"], "run_id", "forward_ms").select("dataset", "run_id", rounded(F.col("best")).alias("best"))


# ---- files ------------------------------------------------------------------------------------------------------------


def shared(s) -> str:
    """A new folder below the checkpoint folder that all executors share."""
    return f"{shared_dir(s)}/{uuid.uuid4().hex}"


@query(f"WITH {RAW} SELECT id, y, split, seg AS category, {rsql('bal')} AS bal FROM (SELECT *, (SELECT count(DISTINCT seg) FROM raw r2 WHERE r2.seg < raw.seg)::INT AS c FROM raw) WHERE true")
def written_and_read(s, d):
    path = io.write_processed(raw(s, d), shared(s), {"split": "TH", "impute": "none"}, inputs=[table(s, d, "customer")])
    return s.read.parquet(path).select("id", "y", "split", F.col("seg").alias("category"), rounded(F.col("bal")).alias("bal"))


@query(f"WITH {RAW} SELECT id, {rsql('bal')} AS bal, {rsql('frac')} AS frac, two::INT AS two, {rsql('y')} AS y, CASE WHEN split = 'train' THEN 'train' WHEN split = 'val' THEN 'val' ELSE 'test' END AS split FROM raw")
def graph_bundle(s, d):
    root, r = shared(s), raw(s, d)
    put = lambda df, name: df.write.option("header", True).csv(f"{root}/{name}.csv")
    put(r.select("id", "bal", "nat", "frac", "two"), "features")
    put(r.select("id", "y"), "targets")
    put(r.select("id", *[(F.col("split") == k).alias(k) for k in ("train", "val", "test")]), "split_masks_TH")
    put(raw_edges(s, d), "edgelist")
    b = io.read_graph_bundle(s, root, "TH", {"target_name": "y", "numerical_features_names": ["bal", "nat", "frac"], "fraction_features_names": ["frac"], "categorical_features_names": ["two"], "task": "regression"})
    return b.nodes.select("id", rounded(F.col("bal")).alias("bal"), rounded(F.col("frac")).alias("frac"), "two", rounded(F.col("y")).alias("y"), "split")


@query(f"WITH {RUNS} SELECT run_id, CASE WHEN run_id % 2 = 0 THEN forward_ms END AS forward_ms, CASE WHEN run_id % 2 = 1 THEN backward_ms END AS backward_ms FROM r")
def united_measurements(s, d):
    r, root = runs(s, d), shared(s)
    io.write_report(r.where("run_id % 2 = 0").select("run_id", "forward_ms"), f"{root}/a")
    io.write_report(r.where("run_id % 2 = 1").select("run_id", "backward_ms"), f"{root}/b")
    return io.read_measurements(s, [f"{root}/a", f"{root}/b"]).select(F.col("run_id").cast("long").alias("run_id"), "forward_ms", "backward_ms")


@query(f"WITH {PARTS} SELECT id, y, split FROM nodes")
def loaded_graph(s, d):
    p = parts(s, d)
    masks = p.select("id", *[F.array(F.col("split") == k, F.lit(True)).alias(k) for k in ("train", "val", "test")])
    n, _ = io.load_graph(p.drop("split").withColumn("y", F.array("y")), bought_together(s, d), masks)
    return n.select("id", "y", "split")


@query(f"WITH {RUNS} SELECT run_id, backend, backward_ms FROM r")
def json_report(s, d):
    path = f"{shared(s)}/report"
    io.write_report(runs(s, d).select("run_id", "backend", "backward_ms"), path, "json")
    return s.read.json(path).select(F.col("run_id").cast("long").alias("run_id"), "backend", "backward_ms")


def reported(s, d, name):
    return flows.benchmark_report(runs(s, d), "click", BACKENDS, "backward_ms")[name]


@query(SQL["gmean_speedup"])
def benchmark_report_gmeans(s, d):
    return reported(s, d, "gmeans").withColumn("gmean", rounded(F.col("gmean"), 5))


@query(SQL["raw_table"])
def benchmark_report_raw(s, d):
    return reported(s, d, "raw")


@query(SQL["graph_summary"])
def benchmark_report_graphs(s, d):
    return reported(s, d, "graphs").withColumn("density", rounded(F.col("density"), 9)).withColumn("average_degree", rounded(F.col("average_degree")))


def generated(s, d, kind):
    """Edges of a generated graph whose nodes are the parts: its numbers stand for the parts' places by key."""
    p = global_positions(table(s, d, "part").select("p_partkey"), ["p_partkey"], "id")
    edges = io.random_graph(s, p.count(), 6.0, 1, kind)
    return relabelled(edges, p, "id", "p_partkey"), table(s, d, "part").select(F.col("p_partkey").alias("id"))


KEYS = "n AS (SELECT count(*) AS n, min(p_partkey) AS lo, max(p_partkey) AS hi FROM part)"


@query(f"WITH {KEYS} SELECT n * 6 AS n_edges, lo >= 0 AS inside FROM n")
def random_uniform_graph(s, d):
    """Number of edges; all their ends are parts."""
    e, nodes = generated(s, d, "uniform")
    ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).join(nodes, "id", "left_anti").agg((F.count("*") == 0).alias("inside"))
    return e.agg(F.count("*").alias("n_edges")).join(F.broadcast(ends))  # one row each


@query("SELECT p_partkey AS id, 1::BIGINT AS loops, true AS both_ways FROM part")
def random_undirected_graph(s, d):
    """Each part has one loop, and for each edge the edge back."""
    e, nodes = generated(s, d, "undirected")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("there"))
    rows = e.join(back, ["src", "dst"], "left").groupBy(F.col("src").alias("id")).agg(F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops"), (F.count("there") == F.count("*")).alias("both_ways"))
    return nodes.join(rows, "id", "left")


@query("SELECT p_partkey AS id, true AS distinct_sources, true AS in_range, 0::BIGINT AS loops FROM part")
def random_poisson_graph(s, d):
    """Every part has between one and all other parts as sources, each once and not itself."""
    e, nodes = generated(s, d, "poisson")
    n = nodes.count()
    rows = e.groupBy(F.col("dst").alias("id")).agg((F.count("*") == F.count_distinct("src")).alias("distinct_sources"), F.count("*").between(1, n - 1).alias("in_range"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops"))
    return nodes.join(rows, "id", "left")


