"""Places, running sums and totals within groups of any size.

Each function has two forms with the same result. The plain one is a window over
the group. The ``split`` one is for groups too large for a task: rows are
range-partitioned by group and order, so that a hot group lies on many tasks in
order, and what came before a task's share is added from per-task totals.
:func:`by_size` sends each group down the form that suits it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomry.session import settle

# A group of more rows than this is spread over tasks.
HOT = 100_000


def by_size(rows: DataFrame, keys: list[str], build: Callable[[DataFrame, bool], DataFrame], hot: int = HOT) -> DataFrame:
    """``build(rows, split)`` of the small groups and of the hot ones, together."""
    kept = settle(rows)
    # At most one group in ``hot`` rows.
    large = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot).drop("__n")
    if large.isEmpty():
        return build(kept, False)
    large = settle(large)
    return build(kept.join(large, keys, "left_anti"), False).unionByName(build(kept.join(large, keys, "left_semi"), True))


def running(rows: DataFrame, keys: list[str], order: list[Column], value: Column, out: str, split: bool = False) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the group that come before. The order must have no ties."""
    if not split:
        return rows.withColumn(out, F.coalesce(F.sum(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranged = settle(rows.withColumn("__value", value).repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    inside = W.partitionBy("__part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = ranged.groupBy(*keys, "__part").agg(F.sum("__value").alias("__sum"))
    before = parts.select(*keys, "__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    joined = ranged.join(before, [*keys, "__part"])
    return joined.withColumn(out, F.col("__before") + F.coalesce(F.sum("__value").over(inside), F.lit(0))).drop("__value", "__part", "__before")


def place(rows: DataFrame, keys: list[str], order: list[Column], out: str, split: bool = False) -> DataFrame:
    """``out``: how many rows of the group come before. The order must have no ties."""
    if split:
        return running(rows, keys, order, F.lit(1), out, True)
    return rows.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def totals(rows: DataFrame, keys: list[str], values: dict[str, Column], split: bool = False) -> DataFrame:
    """Aggregates of the whole group on each of its rows."""
    if not split:
        return rows.withColumns({name: value.over(W.partitionBy(*keys)) for name, value in values.items()})
    return rows.join(rows.groupBy(*keys).agg(*[value.alias(name) for name, value in values.items()]), keys)
