"""One ranking from several differently-scaled scores, by closeness to an ideal point.

Per group, each score is winsorised at two quantiles and divided by its vector
length, the best and worst values of all scores make an ideal and an anti-ideal
point, and items are sorted by how much nearer they are to the first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomry.functions.ranking import HOT, by_size, place, running, totals


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def distinct_items(df: DataFrame, group: str, item: str, arrived: str, columns: list[str]) -> DataFrame:
    """One row per group and item: the earliest arrival, of several the smallest values."""
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull())
    facts = F.min(F.struct(F.col(arrived), *[F.col(c) for c in columns])).alias("row")
    return rows.groupBy(F.col(group).alias("grp"), F.col(item).alias("item")).agg(facts).select("grp", "item", *[F.col(f"row.{c}").alias(c) for c in columns])


def _ranked(items: DataFrame, split: bool, scores: list[str], weights: list[float], lower: float, upper: float) -> DataFrame:
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf"))), F.col(c).cast("double"))
    rows = items.withColumns({f"__{s}": finite(s) for s in scores})
    for s in scores:
        rows = place(rows, ["grp"], [F.asc_nulls_last(f"__{s}"), F.asc("item")], f"__at_{s}", split)
    rows = totals(rows, ["grp"], {f"__n_{s}": F.count(f"__{s}") for s in scores}, split)
    # The quantile is the value at this place among the finite ones, so it is exact whatever the group's size.
    quantile = lambda s, q: F.max(F.when(F.col(f"__at_{s}") == F.greatest(F.ceil(F.lit(q) * F.col(f"__n_{s}")), F.lit(1)) - 1, F.col(f"__{s}")))
    rows = totals(rows, ["grp"], {f"__{name}_{s}": quantile(s, q) for s in scores for name, q in (("low", lower), ("high", upper))}, split)
    for s in scores:
        low, high = F.col(f"__low_{s}"), F.col(f"__high_{s}")
        rows = rows.withColumn(f"__{s}", F.when(F.col(f"__{s}").isNull(), low).otherwise(F.greatest(low, F.least(high, F.col(f"__{s}")))))
    extent = {}
    for s in scores:
        extent |= {f"__len_{s}": F.sum(F.col(f"__{s}") ** 2), f"__max_{s}": F.max(f"__{s}"), f"__min_{s}": F.min(f"__{s}")}
    rows = totals(rows, ["grp"], extent, split)
    for s in scores:
        names = (f"__{s}", f"__max_{s}", f"__min_{s}")
        rows = rows.withColumns({name: F.when(F.col(f"__len_{s}") > 0, F.col(name) / F.sqrt(f"__len_{s}")).otherwise(F.lit(0.0)) for name in names})
    gap = lambda bound: F.sqrt(_sum([F.pow(F.coalesce(F.lit(w) * (F.col(f"__{s}") - F.col(f"__{bound}_{s}")), F.lit(0.0)), F.lit(2.0)) for s, w in zip(scores, weights)]))
    best, worst = gap("max"), gap("min")
    rows = rows.withColumn("closeness", F.when(best + worst > 0, worst / (best + worst)).otherwise(F.lit(1.0)))
    kept = rows.select(*items.columns, *[F.col(f"__{s}").alias(f"{s}_n") for s in scores], "closeness")
    return place(kept, ["grp"], [F.desc("closeness"), F.asc("item")], "ideal_rank", split).withColumn("ideal_rank", (F.col("ideal_rank") + 1).cast("int"))


def ideal_point_ranking(items: DataFrame, scores: list[str], weights: list[float] | None = None, lower: float = 0.05, upper: float = 0.95, hot: int = HOT) -> DataFrame:
    """``items`` (columns ``grp, item`` and the scores) with ``<score>_n``, ``closeness`` and ``ideal_rank``.

    ``<score>_n`` is the winsorised, vector-normalised score. Higher scores are
    better. A null or non-finite score counts as the group's worst; a score that
    is equal (or missing) throughout a group has no say; where no score has a
    say, closeness is 1 for all and the order is that of ``item``. Ties are
    broken by ``item``, which must be unique in its group. Other columns are
    carried along. Groups of more than ``hot`` items are spread over tasks, with
    the same result.
    """
    chosen = weights or [1.0 / len(scores)] * len(scores)
    return by_size(items, ["grp"], lambda rows, split: _ranked(rows, split, scores, chosen, lower, upper), hot)


def _one_sided(ranked: DataFrame, split: bool, order: str, first: str, second: str, least: int, rising: float) -> DataFrame:
    both = ranked.where(F.col(first).isNotNull() & F.col(second).isNotNull() & ~F.isnan(first) & ~F.isnan(second))
    rows = place(both, ["grp"], [F.col(order).asc_nulls_last(), F.asc("item")], "pos", split)
    # Where one score alone makes the order, the ranking's normalised score never rises along it: its own order is the recorded one.
    for s in (first, second):
        rows = place(rows, ["grp"], [F.desc(f"{s}_n"), F.asc("pos")], f"__at_{s}", split)
    agrees = {f"__follows_{s}": F.min(F.col(f"__at_{s}") == F.col("pos")) for s in (first, second)}
    rows = totals(rows, ["grp"], {"n": F.count(F.lit(1)), **agrees}, split)
    rows = rows.where((F.col("n") >= least) & (F.col(f"__follows_{first}") | F.col(f"__follows_{second}")))
    # Winsorising and dividing leave ties that the scores themselves do not have: the exact check is on those.
    for s in (first, second):
        rows = place(rows, ["grp"], [F.desc(s), F.desc("pos")], f"__at_{s}", split)
    rows = totals(rows, ["grp"], {f"__falls_{s}": F.min((F.col(f"__at_{s}") == F.col("pos")) & F.col(f"__follows_{s}")) for s in (first, second)}, split)
    lead = F.explode(F.array_compact(F.array(*[F.when(F.col(f"__falls_{s}"), F.lit(s)) for s in (first, second)])))
    sides = rows.select("grp", "n", "pos", first, second, lead.alias("leading")).select(
        "grp", "n", "pos", "leading", F.when(F.col("leading") == first, F.col(second)).otherwise(F.col(first)).alias("other")
    )
    bits = F.ceil(F.log2(F.col("n"))).cast("int")
    levels = sides.withColumn("bit", F.explode(F.sequence(F.lit(0), F.greatest(bits - 1, F.lit(0)))))
    # A pair's higher bits agree, and at this bit the earlier item has 0 and the later one 1.
    halves = levels.withColumns({"upper": F.expr("shiftright(pos, bit + 1)"), "later": F.expr("shiftright(pos, bit)") % 2})
    # Of equal scores the later items come first, so that only strictly smaller ones stand before them.
    rises = running(halves, ["grp", "leading", "bit", "upper"], [F.asc("other"), F.desc("later"), F.asc("pos")], 1 - F.col("later"), "smaller", split)
    counted = rises.where(F.col("later") == 1).groupBy("grp", "leading", "n").agg(F.sum("smaller").alias("rises"))
    share = F.col("rises") / (F.col("n") * (F.col("n") - 1) / 2)
    return counted.select("grp", "leading", share.alias("share")).where(F.col("share") >= rising)


def one_sided_groups(items: DataFrame, order: str, first: str, second: str, least: int = 5, rising: float = 0.4, hot: int = HOT) -> DataFrame:
    """Groups whose recorded ``order`` follows one score alone: ``grp, leading, share``.

    Of the items with both scores, at least ``least``: one score falls strictly
    all the way down the order, while the other rises in at least ``rising`` of
    all pairs. Items with the same recorded place follow each other in the order
    of ``item``. ``share`` is the share of pairs in which the other score rises.

    The ideal-point ranking's normalised scores choose the groups: the recorded
    order must be that of one of them. That keeps every true group, as winsorising
    and normalising keep a falling score from rising; the raw scores are
    compared only within the chosen groups. Pairs are never formed: rising pairs
    are counted place bit by place bit, as in a merge sort, so a group of n items
    costs n log n.
    """
    scores = [first, second]
    half = [1.0 / len(scores)] * len(scores)
    return by_size(items, ["grp"], lambda rows, split: _one_sided(_ranked(rows, split, scores, half, 0.05, 0.95), split, order, first, second, least, rising), hot)
