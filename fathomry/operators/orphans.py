"""References to records that do not exist.

Parent and child keys are brought into one long form, grouped by parent table
and key, and the groups that lack their parent (or got it too late, or lost it)
are kept; only the children of those groups are looked at again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomry.functions.skew import HOT, salted_join
from fathomry.session import settle


@dataclass(frozen=True)
class Parent:
    """``deleted_when`` with ``version``: the row with the greatest version says whether the record is gone."""

    name: str
    rows: DataFrame
    key: str
    arrived: str
    version: str | None = None
    deleted: Column | None = None


@dataclass(frozen=True)
class Child:
    """``key`` is a column or expression; an ``alive`` child also counts as stray if its parent is deleted."""

    table: str
    field: str
    parent: str
    rows: DataFrame
    record: str
    key: Column
    arrived: str
    alive: bool = False


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def references(children: list[Child]) -> DataFrame:
    """Every (record, key) once, with the earliest arrival of the *record*.

    Null keys refer to nothing and are left out; null records are kept (as one
    record), and an empty string is a key like any other.
    """
    parts = []
    for child in children:
        rows = child.rows.select(
            F.lit(child.parent).alias("parent"),
            F.lit(child.table).alias("ref_table"),
            F.lit(child.field).alias("ref_field"),
            F.lit(child.alive).alias("alive"),
            F.col(child.record).cast("string").alias("record_id"),
            child.key.alias("keys"),
            F.col(child.arrived).alias("arrived"),
        )
        is_list = dict(rows.dtypes)["keys"].startswith("array")
        # An array of keys stays whole until the record's first arrival is known.
        first = rows.groupBy("parent", "ref_table", "ref_field", "alive", "record_id", "keys").agg(F.min("arrived").alias("arrived"))
        exploded = first.withColumn("ref_key", F.explode("keys") if is_list else F.col("keys")).drop("keys")
        parts.append(exploded.where(F.col("ref_key").isNotNull()).withColumn("ref_key", F.col("ref_key").cast("string")))
    keys = _union(parts)
    return keys.groupBy("parent", "ref_table", "ref_field", "alive", "record_id", "ref_key").agg(F.min("arrived").alias("arrived"))


def orphans(parents: list[Parent], children: list[Child], hot: int = HOT) -> DataFrame:
    """Stray references: ``ref_table, ref_field, record_id, ref_key, arrived, reason``.

    A reference is stray if no row of its key had arrived at or before the
    record's own earliest arrival (``missing`` if none ever arrives, ``late`` if
    one does later), or, for ``alive`` children, if the newest version of the
    parent is deleted (``deleted``). Keys compare as written.

    Repeated rows count once. A null arrival of a child is later than any
    parent's; a null arrival of a parent is ignored. Empty tables are fine: with
    no parents every reference is missing.

    Children are read once: their references are kept while their groups are
    judged, and a key that many refer to is spread over tasks as its count says.
    """
    refs = settle(references(children))
    facts = []
    for parent in parents:
        gone = F.max(F.struct(F.col(parent.version).alias("v"), F.coalesce(parent.deleted, F.lit(False)).alias("d")))["d"] if parent.version else F.lit(False)
        facts.append(
            parent.rows.where(F.col(parent.key).isNotNull())
            .groupBy(F.col(parent.key).cast("string").alias("ref_key"))
            .agg(F.min(parent.arrived).alias("since"), gone.alias("deleted"))
            .select(F.lit(parent.name).alias("parent"), "ref_key", F.lit(True).alias("is_parent"), "since", "deleted", F.lit(None).cast("timestamp").alias("first_use"), F.lit(False).alias("alive"), F.lit(0).cast("long").alias("uses"))
        )
    uses = refs.groupBy("parent", "ref_key").agg(F.min(F.coalesce("arrived", F.lit("0001-01-01").cast("timestamp"))).alias("first_use"), F.max("alive").alias("alive"), F.count(F.lit(1)).alias("uses")).select(
        "parent", "ref_key", F.lit(False).alias("is_parent"), F.lit(None).cast("timestamp").alias("since"), F.lit(False).alias("deleted"), "first_use", "alive", "uses"
    )
    groups = _union([*facts, uses]).groupBy("parent", "ref_key").agg(
        F.max("is_parent").alias("known"), F.min("since").alias("since"), F.max("deleted").alias("deleted"), F.min("first_use").alias("first_use"), F.max("alive").alias("alive"), F.sum("uses").alias("uses")
    )
    suspects = groups.where(
        F.col("first_use").isNotNull() & (~F.col("known") | F.col("since").isNull() | (F.col("since") > F.col("first_use")) | (F.col("deleted") & F.col("alive")))
    ).select("parent", "ref_key", "known", "since", "deleted", "uses")
    joined = salted_join(refs, settle(suspects), ["parent", "ref_key"], "uses", ["record_id"], hot)
    reason = (
        F.when(~F.col("known") | F.col("since").isNull(), "missing")
        .when(F.col("arrived") < F.col("since"), "late")
        .when(F.col("deleted") & F.col("alive"), "deleted")
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("ref_table", "ref_field", "record_id", "ref_key", "arrived", "reason")


def orphan_report(stray: DataFrame) -> DataFrame:
    """Stray references per table, field, month of arrival and reason."""
    month = F.date_format("arrived", "yyyy-MM").alias("month")
    return stray.groupBy("ref_table", "ref_field", month, "reason").agg(
        F.count(F.lit(1)).alias("n_references"), F.countDistinct("record_id").alias("n_records")
    )
