"""Metrics of prediction tables: y (label), pred (predicted label), score or logits; each gives one row unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.positions import running_sum


def masked(rows: DataFrame, split: str, column: str = "split") -> DataFrame:
    return rows.where(F.col(column) == split)


def labelled(rows: DataFrame, mask: Column, y: str = "y") -> DataFrame:
    """Rows under the mask that have a label: neither null nor NaN."""
    return rows.where(mask & F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))


def accuracy(rows: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Share of equal labels; 0 without rows."""
    return rows.agg(F.coalesce(F.avg((F.col(y) == F.col(pred)).cast("double")), F.lit(0.0)).alias("accuracy"))


def class_counts(rows: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """(label, tp, fp, fn) over labels in either column."""
    pairs = rows.groupBy(F.col(y).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    side = lambda c, fp: pairs.select(F.col(c).alias("label"), F.when(F.col("y") == F.col("p"), F.col("n") if fp else 0).otherwise(0).alias("tp"), F.when((F.col("y") != F.col("p")) & F.lit(fp), F.col("n")).otherwise(0).alias("fp"), F.when((F.col("y") != F.col("p")) & F.lit(not fp), F.col("n")).otherwise(0).alias("fn"))
    return side("p", True).unionByName(side("y", False)).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def _safe(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b))


def f1(rows: DataFrame, average: str = "macro", y: str = "y", pred: str = "pred") -> DataFrame:
    """F1 by macro, micro or weighted average; an undefined quotient is 0."""
    c = class_counts(rows, y, pred)
    one = _safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    if average == "macro":
        value = F.avg(one)
    elif average == "micro":
        value = _safe(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))
    elif average == "weighted":
        value = _safe(F.sum(one * (F.col("tp") + F.col("fn"))), F.sum(F.col("tp") + F.col("fn")))
    else:
        raise ValueError(f"unknown average {average}")
    return c.agg(F.coalesce(value, F.lit(0.0)).alias("f1"))


def precision_recall(rows: DataFrame, y: str = "y", pred: str = "pred", positive: int = 1) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    is_y, is_p = F.col(y) == positive, F.col(pred) == positive
    return rows.agg(_safe(n(is_y & is_p), n(is_p)).alias("precision"), _safe(n(is_y & is_p), n(is_y)).alias("recall"))


def auc(rows: DataFrame, y: str = "y", score: str = "score", by: list[str] = ()) -> DataFrame:
    """Area under the ROC curve from counts by score, ties half; 0.5 if one class is missing; one row for each group ``by``."""
    groups = rows.groupBy(*by, F.col(score).alias("_x")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("_p"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("_n"))
    below = running_sum(groups, ["_x"], F.col("_n").cast("long"), "_b", list(by))
    wins = F.sum(F.col("_p") * (F.col("_b") + F.col("_n") / 2))
    pairs = F.sum("_p").cast("double") * F.sum("_n")
    return below.groupBy(*by).agg(F.coalesce(F.when(pairs > 0, F.try_divide(wins, pairs)), F.lit(0.5)).alias("auc"))


def binary_score(logits: Column) -> Column:
    """Score of a row of logits: the one there is, or of two the softmax of the second."""
    return F.when(F.size(logits) == 2, F.get(V.softmax(logits), F.lit(1))).otherwise(F.get(logits, F.lit(0)))


def multiclass_auc(rows: DataFrame, y: str = "y", logits: str = "logits") -> DataFrame:
    """Mean over classes of the one-vs-rest area under the curve of the softmax."""
    each = rows.select(y, F.posexplode(V.softmax(F.col(logits))).alias("class", "score")).withColumn("_is", (F.col(y) == F.col("class")).cast("int"))
    return auc(each, "_is", "score", ["class"]).agg(F.avg("auc").alias("auc"))


def regression(rows: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """(mse, mae, r2); r2 about the mean of y by two passes, 0 where y is constant."""
    e = F.col(y) - F.col(pred)
    mean = rows.agg(F.avg(y).alias("_m"))
    out = rows.join(F.broadcast(mean)).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_r"), F.sum((F.col(y) - F.col("_m")) ** 2).alias("_t"))  # one row
    return out.select("mse", "mae", F.when(F.col("_t") == 0, F.lit(0.0)).otherwise(1 - F.try_divide("_r", "_t")).alias("r2"))


def epoch_metrics(rows: DataFrame) -> DataFrame:
    """Per epoch: mean loss over batches and accuracy over all predictions; rows (epoch, batch, loss, y, pred)."""
    loss = rows.groupBy("epoch", "batch").agg(F.first("loss").alias("loss")).groupBy("epoch").agg(F.avg("loss").alias("loss"))
    hits = rows.groupBy("epoch").agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))
    return loss.join(hits, "epoch")


def early_stop(history: DataFrame, patience: int, value: str = "value") -> DataFrame:
    """(best_epoch, best_value, stop_epoch): first best epoch up to the first one after ``patience`` checks without improvement.

    History has one row for each check of one run, so its order fits one task.
    """
    order = Window.orderBy("epoch")
    before = F.max(value).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = history.withColumn("_new", before.isNull() | (F.col(value) > before)).withColumn("_n", F.row_number().over(order))
    since = marked.withColumn("_since", F.col("_n") - F.max(F.when(F.col("_new"), F.col("_n"))).over(order))
    stop = since.where(F.col("_since") >= patience).agg(F.min("epoch").alias("stop_epoch"))
    seen = since.join(F.broadcast(stop)).where(F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch")))
    return seen.agg(F.max(F.when(F.col("_new"), F.struct(F.col("epoch").alias("e"), F.col(value).alias("v")))).alias("b"), F.max("stop_epoch").alias("stop_epoch")).select(F.col("b.e").alias("best_epoch"), F.col("b.v").alias("best_value"), "stop_epoch")
