"""How distinctive a term is per record: term frequency times smoothed logarithmic inverse document frequency.

The weight of a term in a record is

    tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length)) * ln(1 + (N - df + 0.5) / (df + 0.5))

with ``tf`` the term's occurrences in the record, ``df`` the records that hold
it, ``N`` all records and lengths in terms, so that the sum over a query's
distinct terms is the record's keyword score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomry.functions.skew import HOT, salted_join
from fathomry.functions.text import terms

# Saturation and length normalisation of the keyword score.
K1 = 1.2
B = 0.75


def one_row_per_record(df: DataFrame, record: str, text: str, arrived: str | None = None) -> DataFrame:
    """``(record, text)``, one row per record: the earliest arrival's text, of several the smallest.

    Rows are partitioned by record, which the steps after it rely on. Repeated
    rows of a hot record are merged map-side, before they are shuffled.
    """
    order = F.struct(F.col(arrived) if arrived else F.lit(0), F.col(text))
    return df.where(F.col(record).isNotNull()).groupBy(F.col(record).alias("record")).agg(F.min_by(F.col(text), order).alias("text"))


def inverse_document_frequency(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, length: Column, average: Column, idf: Column, k1: float = K1, b: float = B) -> Column:
    return idf * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length / average))


def distinctive_terms(
    df: DataFrame, record: str, text: str, arrived: str | None = None, min_tf: int = 1, min_df: int = 1, max_df: int | None = None, k1: float = K1, b: float = B
) -> DataFrame:
    """``record, term, tf, df, idf, score`` for every term of every record.

    ``min_tf``, ``min_df`` and ``max_df`` choose which rows come out; the
    statistics always cover all records. Records whose text is null or has no
    terms count as records of length 0 and give no rows; rows with a null record
    are ignored; repeated rows of a record count once; an empty table gives no
    rows. Other columns of ``df`` are not looked at, whatever their names.

    Records are shuffled once, by their key, so that counting a record's terms
    needs no further shuffle; the distinct term-record pairs are pre-aggregated
    per task, and only the terms' counts are shuffled. In the join back a
    term of very many records is spread over salts, as many as its count asks for.
    """
    base = one_row_per_record(df, record, text, arrived).withColumn("terms", terms(F.col("text"))).drop("text")
    frequency = base.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = frequency.where(F.col("df") >= min_df)
    if max_df is not None:
        kept = kept.where(F.col("df") <= max_df)
    totals = base.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.greatest(F.size("terms"), F.lit(0)), F.lit(0))).alias("average"))
    n, average = totals.select("n").scalar(), totals.select("average").scalar()
    counts = (
        base.select("record", F.size("terms").alias("length"), F.explode("terms").alias("term"))
        .groupBy("record", "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
        .where(F.col("tf") >= min_tf)
    )
    if max_df is not None and max_df <= HOT:
        joined = counts.join(kept, "term")
    else:
        joined = salted_join(counts, kept, ["term"], "df", ["record"])
    idf = inverse_document_frequency(n, F.col("df"))
    return joined.select(
        "record", "term", "tf", "df", idf.alias("idf"), weight(F.col("tf"), F.col("length"), average, idf, k1, b).alias("score")
    )
