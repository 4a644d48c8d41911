"""Global positions, running sums and quantiles in a given order, without a window or a hash map over the whole table in one task.

Rows are range-partitioned and sorted; each partition's total is small; totals of the partitions before are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written


def running_sum(df: DataFrame, order: list[str | Column], value: Column, out: str, by: list[str] = ()) -> DataFrame:
    """``df`` with the exclusive running sum of ``value`` over the order, which must be total, within the groups ``by``.

    The groups come first in the order, so that a large group spreads over partitions too.  The ranges are written once with
    their numbers: totals and rows then speak of the same ranges, whatever is computed again.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in [*by, *order]]
    ranged = written(df.withColumns({f"_order{i}": k for i, k in enumerate(keys)}).withColumn("_value", value).repartitionByRange(*[F.col(f"_order{i}") for i in range(len(keys))]).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part", *by).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_part") if by else Window.orderBy("_part")
    # one row for each partition and group that meet: the ends of each group's range
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    local = Window.partitionBy("_part", *by).orderBy(*[F.col(f"_order{i}") for i in range(len(by), len(keys))]).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_local", F.coalesce(F.sum("_value").over(local), F.lit(0)))
    condition = summed["_part"] == offsets["_part"]
    for c in by:
        condition &= summed[c].eqNullSafe(offsets[c])
    joined = summed.join(offsets, condition)
    return joined.select(*[summed[c] for c in df.columns], (F.col("_local") + F.col("_before")).alias(out))


def global_positions(df: DataFrame, order: list[str | Column], out: str = "pos") -> DataFrame:
    """``df`` with each row's position in the order, from 0; the order must be total."""
    return running_sum(df, order, F.lit(1).cast("long"), out)


def quantiles(rows: DataFrame, by: list[str], value: str, parts: int) -> DataFrame:
    """(by, i, q): the exact, linearly interpolated quantiles i / parts of each group, i from 0 to parts.

    Equal values are counted first; the ranks of a counted value tell which quantiles lie on it or next to it.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    ranked = written(running_sum(counted, ["_v"], F.col("_c"), "_b", by))
    n = ranked.groupBy(*by).agg(F.sum("_c").alias("_n")) if by else ranked.agg(F.sum("_c").alias("_n"))
    # place of quantile i: (n - 1) i / parts; the value below it has the last rank up to it, the value above the first rank from it
    both = ranked.join(n, by) if by else ranked.join(F.broadcast(n))  # one row
    last, low, high = F.col("_n") - 1, F.col("_b"), F.col("_b") + F.col("_c")
    near = lambda a: F.coalesce(F.floor(F.try_divide(a * parts, last)), F.lit(0))
    some = lambda a, b: F.sequence(F.greatest(F.lit(0), near(a) - 1), F.when(last > 0, F.least(F.lit(parts), near(b) + 2)).otherwise(F.lit(parts)))
    below = F.filter(some(low, high), lambda i: (i * last >= low * parts) & (i * last < high * parts))
    above = F.filter(some(low - 1, high - 1), lambda i: (i * last > (low - 1) * parts) & (i * last <= (high - 1) * parts))
    each = both.select(*by, "_v", "_n", F.inline(F.concat(F.transform(below, lambda i: F.struct(i.alias("i"), F.lit(0).alias("side"))), F.transform(above, lambda i: F.struct(i.alias("i"), F.lit(1).alias("side"))))))
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("_v")))
    met = each.groupBy(*by, "i").agg(side(0).alias("_lo"), side(1).alias("_hi"), F.max("_n").alias("_n"))
    place = (F.col("_n") - 1) * F.col("i") / parts
    return met.select(*by, F.col("i").cast("int").alias("i"), (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (place - F.floor(place))).alias("q"))


def column_quantiles(rows: DataFrame, columns: list[str], parts: int) -> dict[str, list[float]]:
    """The parts + 1 evenly spaced quantiles of each column, on the driver; empty for a column without a value."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.c", "x.v")
    found: dict[str, dict[int, float]] = {c: {} for c in columns}
    for r in quantiles(long, ["c"], "v", parts).collect():
        found[r["c"]][r["i"]] = r["q"]
    return {c: [q[i] for i in sorted(q)] for c, q in found.items()}
