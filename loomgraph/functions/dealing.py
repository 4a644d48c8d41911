"""Grouping of very many narrow rows in tasks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task, by the mean; tables with fewer than FEW are left to Spark.
ROWS, FEW = 2_000_000, 8_000_000


def dealt(df: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """``df`` dealt by its keys over partitions of ROWS rows or so; ``like`` is a table of about as many rows that is cheaper to count.

    Spark joins shuffle partitions up to a number of bytes, and narrow rows are compressed to a few: a task would hold millions of groups in its
    hash map, more with every GB.  A grouping by the keys shuffles no more behind this.
    """
    n = (df if like is None else like).count()
    return df.repartition(-(-n // ROWS), *keys) if n > FEW else df
