"""Summaries of measurement tables: one row a run, with its setup in columns and its times and memory in others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.positions import quantiles

SETUP = ["conv_type", "dataset", "feature_dim", "heads", "graph_reordering_partition_size"]
MEASURES = ["forward_ms", "backward_ms", "total_ms", "forward_memory_mb", "backward_memory_mb"]


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def derived(rows: DataFrame) -> DataFrame:
    """With total_ms, density and average degree."""
    e, n = F.col("num_edges").cast("double"), F.col("num_nodes")
    return rows.withColumns({"total_ms": F.col("forward_ms") + F.col("backward_ms"), "density": F.try_divide(e, n * (n - 1)), "average_degree": F.try_divide(e, n)})


def allowed(rows: DataFrame, column: str, allow: list | None = None, deny: list | None = None) -> DataFrame:
    out = rows.where(F.col(column).isin(allow)) if allow is not None else rows
    return out.where(~F.col(column).isin(deny)) if deny else out


def relabel(c: Column, names: dict) -> Column:
    """Values replaced through a lookup; others stay as text."""
    return reduce(lambda out, kv: out.when(c == kv[0], kv[1]), list(names.items())[1:], F.when(c == next(iter(names)), next(iter(names.values())))).otherwise(c.cast("string"))


def drop_constant_columns(rows: DataFrame) -> DataFrame:
    """Without the columns in which all rows are equal (null is a value)."""
    differs = lambda c: ~F.min(c).eqNullSafe(F.max(c)) | (F.count(c).between(1, F.count("*") - 1))
    varied = rows.agg(*[differs(c).alias(c) for c in rows.columns]).first()
    return rows.select([c for c in rows.columns if varied[c]])


def speedup(rows: DataFrame, baseline: str, keys: list[str] = SETUP, measures: list[str] = MEASURES, run: str = "run_id") -> DataFrame:
    """Each row with <measure>_speedup: the value of the baseline's first run of the same setup over its own.

    Null where either is missing, not finite or not above 0.
    """
    first = rows.where(F.col("backend") == baseline).groupBy(*keys).agg(*[F.min_by(m, run).alias(f"_{m}") for m in measures])
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    joined = rows.alias("l").join(first.alias("r"), same, "left")
    good = lambda c: finite(c) & (c > 0)
    ups = [F.when(good(F.col(f"_{m}")) & good(F.col(f"l.{m}")), F.col(f"_{m}") / F.col(f"l.{m}")).alias(f"{m}_speedup") for m in measures]
    return joined.select("l.*", *ups)


def pivoted(rows: DataFrame, keys: list[str], names: list[str], value: str, how: str, column: str = "backend") -> DataFrame:
    """One row a setup, one column a name, by max, min, first (by value of run_id) or avg, in the order of keys and names."""
    agg = {"max": F.max(value), "min": F.min(value), "avg": F.avg(value), "first": F.min_by(value, "run_id") if "run_id" in rows.columns else F.first(value)}[how]
    return rows.groupBy(*keys).pivot(column, sorted(names)).agg(agg).orderBy(*keys)


def speedup_table(rows: DataFrame, baseline: str, backends: list[str], measure: str = "forward_ms", keys: list[str] = SETUP) -> DataFrame:
    """Best speed-up by backend, without the baseline's column."""
    ups = speedup(rows, baseline, keys, [measure])
    return pivoted(ups, keys, [b for b in backends if b != baseline], f"{measure}_speedup", "max")


def raw_table(rows: DataFrame, backends: list[str], measure: str = "forward_ms", keys: list[str] = SETUP) -> DataFrame:
    return pivoted(rows, keys, backends, measure, "min")


def to_long(table: DataFrame, keys: list[str], name: str = "backend", value: str = "value") -> DataFrame:
    return table.unpivot(keys, [c for c in table.columns if c not in keys], name, value)


def setup_tables(rows: DataFrame, backends: list[str], measure: str = "forward_ms") -> DataFrame:
    """All setups (conv, heads, dim) in one table, their datasets below each other; a filter on the setup gives its table."""
    keys = ["conv_type", "heads", "feature_dim", "dataset"]
    return pivoted(rows, keys, backends, measure, "first")


def gmean_speedup(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Geometric mean of the positive values."""
    return long.groupBy(*by).agg(F.exp(F.avg(F.when(F.col(value) > 0, F.ln(value)))).alias("gmean"))


def ratio_to_level(rows: DataFrame, keys: list[str], level: str, reference, value: str) -> DataFrame:
    """With ratio: the value over the one at the reference level of its group (the largest, if several)."""
    base = rows.where(F.col(level) == reference).groupBy(*keys).agg(F.max(value).alias("_base"))
    return rows.join(base, keys, "left").withColumn("ratio", F.try_divide(value, "_base")).drop("_base")


def variant_diff(rows: DataFrame, keys: list[str], variant: str, a, b, value: str) -> DataFrame:
    """Difference b - a, ratio b / a and percentage by group of the means of two variants."""
    m = lambda x: F.avg(F.when(F.col(variant) == x, F.col(value)))
    out = rows.groupBy(*keys).agg(m(a).alias("value_a"), m(b).alias("value_b"))
    return out.withColumns({"diff": F.col("value_b") - F.col("value_a"), "ratio": F.try_divide("value_b", "value_a"), "percent": F.try_divide((F.col("value_b") - F.col("value_a")) * 100, "value_a")})


def melt_diff(diff: DataFrame, keys: list[str], level: str, reference) -> DataFrame:
    """Long form of a difference table without its reference level, negated."""
    long = diff.where(F.col(level) != reference).unpivot([*keys, level], [c for c in diff.columns if c not in (*keys, level)], "metric", "value")
    return long.withColumn("value", -F.col("value"))


def box_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 quartile ranges) and number of outliers of each group."""
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("q")))
    q = quantiles(rows, by, value, 4).groupBy(*by).agg(at(1).alias("q1"), at(2).alias("median"), at(3).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.join(q, by, "left").groupBy(*by, "q1", "median", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.sum((~inside).cast("long")).alias("outliers"))


def compare_runs(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per setup: old, new, absolute and relative difference."""
    both = old.select(*keys, F.col(value).alias("old")).join(new.select(*keys, F.col(value).alias("new")), keys)
    return both.withColumn("diff", F.col("new") - F.col("old")).withColumn("relative", F.try_divide("diff", "old"))


def mean_by_dataset(compared: DataFrame) -> DataFrame:
    return compared.groupBy("dataset").agg(F.avg("diff").alias("mean_diff"), F.avg("relative").alias("mean_relative"))


def backend_pivot(rows: DataFrame, keys: list[str], backends: list[str], measures: list[str]) -> DataFrame:
    """Mean of repeated runs as flat columns <backend>_<measure>."""
    cells = [F.avg(F.when(F.col("backend") == b, F.col(m))).alias(f"{b}_{m}") for b in sorted(backends) for m in measures]
    return rows.groupBy(*keys).agg(*cells)


def best_config(trials: DataFrame, keys: list[str], config: list[str], ms: str = "ms", run: str = "run_id") -> DataFrame:
    """The configuration with the least time of each key, the first run of equals."""
    best = trials.groupBy(*keys).agg(F.min_by(F.struct(*config, ms), F.struct(ms, run)).alias("b"))
    return best.select(*keys, "b.*")


def running_best(history: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """``history`` with the best value of its group so far."""
    return history.withColumn("best", F.max(value).over(Window.partitionBy(*by).orderBy(order)))
