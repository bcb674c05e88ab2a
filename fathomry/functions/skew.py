"""Joins on keys of which one may hold much of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is spread over as many salts as that takes.
HOT = 1_000_000


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, by: list[Column | str], hot: int = HOT) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row per key and says in ``size`` how many rows it has at most.

    Rows of a hot key are spread by a hash of ``by`` over salts, whose number
    grows with the key's size; all others join as they are. The hot keys are sent
    to every task: there is at most one in ``hot`` rows, a few bytes each.
    """
    salts = F.greatest(F.ceil(F.col(size) / F.lit(hot)), F.lit(1)).cast("int")
    large = facts.where(F.col(size) > hot).select(*keys, salts.alias("__salts"))
    left = rows.join(F.broadcast(large), keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*by), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    right = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [*keys, "__salt"]).drop("__salt")
