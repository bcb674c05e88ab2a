"""Keyword search: corpus statistics and BM25 for batches of queries."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from fathomry.functions.scoring import B, K1
from fathomry.functions.text import LOWER, UPPER, terms
from fathomry.operators.topk import CELLS, Best, in_batches
from fathomry.session import spread

_TERM = re.compile("[a-z0-9]+")
_FOLD = str.maketrans(UPPER, LOWER)
# Records scored at a time, and queries: a block's weights are terms by queries.
RECORDS, QUERIES = 1024, 256


def corpus_stats(records: DataFrame, record: str, text: str) -> DataFrame:
    """One row: ``n`` records (without terms too) and their ``average`` length in terms."""
    length = F.coalesce(F.size(terms(F.coalesce(F.col(text), F.lit("")))), F.lit(0))
    return records.where(F.col(record).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(length), F.lit(0.0)).alias("average"))


def term_stats(records: DataFrame, record: str, text: str) -> DataFrame:
    """``term, df, occurrences``: in how many records each term occurs, and how often; one count, merged where records are read."""
    named = records.where(F.col(record).isNotNull()).select(terms(F.col(text)).alias("all"))
    marked = lambda values, flag: F.transform(values, lambda t: F.struct(t.alias("term"), F.lit(flag).alias("once")))
    both = named.select(F.explode(F.concat(marked(F.col("all"), 0), marked(F.array_distinct("all"), 1))).alias("x"))
    return both.groupBy(F.col("x.term").alias("term")).agg(F.sum("x.once").alias("df"), F.count_if(F.col("x.once") == 0).alias("occurrences"))


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """``query_id, term``: each query's distinct terms; blank and null queries have none."""
    return queries.select(F.col(query).alias("query_id"), F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))


def asked_weights(asked: DataFrame, records: DataFrame, record: str, text: str) -> tuple[pd.DataFrame, float]:
    """``query_id, term, idf`` of the asked terms that occur, and the records' average length; the records are read once."""
    spark = records.sparkSession
    wanted = pd.DataFrame(asked.collect(), columns=["query_id", "term"])
    # The empty term, which no text has, stands for the records themselves: its count is theirs, its lengths are all.
    names = spark.createDataFrame([(t,) for t in {"", *wanted["term"]}], "term string")
    split = spread(records.where(F.col(record).isNotNull()).select(F.col(text))).select(F.coalesce(terms(F.col(text)), F.array().cast("array<string>")).alias("all"))
    each = split.select(F.size("all").alias("length"), F.explode(F.concat(F.array_distinct("all"), F.array(F.lit("")))).alias("term"))
    counted = each.join(names, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("total")).collect()
    df = {r.term: r.df for r in counted}
    whole = next((r for r in counted if r.term == ""), None)
    if whole is None:
        return wanted[:0].assign(idf=0.0), 0.0
    found = wanted[wanted["term"].isin(df)].copy()
    found["idf"] = [math.log(1.0 + (whole.df - df[t] + 0.5) / (df[t] + 0.5)) for t in found["term"]]
    return found, whole.total / whole.df


class _Scorer:
    """BM25 of a part of the queries for the records of a task."""

    def __init__(self, weights: pd.DataFrame, average: float, depths: dict):
        self.queries = np.array(sorted(set(weights["query_id"])), dtype=object)
        self.depths = np.array([max(1, depths[q]) for q in self.queries], np.int64)
        self.average = average or 1.0
        self.places = {t: i for i, t in enumerate(sorted(set(weights["term"])))}
        at = {q: i for i, q in enumerate(self.queries)}
        weights = pd.DataFrame({"q": weights["query_id"].map(at), "t": weights["term"].map(self.places), "w": weights["idf"].astype(float)})
        self.blocks = []
        for first in range(0, len(self.queries), QUERIES):
            part = weights[(weights["q"] >= first) & (weights["q"] < first + QUERIES)]
            used = np.unique(part["t"])
            dense = np.zeros((len(used), min(QUERIES, len(self.queries) - first)))
            dense[np.searchsorted(used, part["t"]), part["q"] - first] = part["w"]
            self.blocks.append((first, used, dense))

    def _postings(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, columns, values = [], [], []
        for i, text in enumerate(texts):
            found = _TERM.findall(text.translate(_FOLD)) if text else []
            base = K1 * (1.0 - B + B * len(found) / self.average)
            for term, tf in Counter(found).items():
                place = self.places.get(term)
                if place is not None:
                    rows.append(i)
                    columns.append(place)
                    values.append(tf * (K1 + 1.0) / (tf + base))
        return np.array(rows, np.int64), np.array(columns, np.int64), np.array(values, float)

    def read(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(self.depths)
        for batch in batches:
            for start in range(0, len(batch), RECORDS):
                part = batch[start : start + RECORDS]
                names, ties = part["record"].to_numpy(object), part["tie"].to_numpy(object)
                r, c, v = self._postings(list(part["text"]))
                for first, used, dense in self.blocks:
                    at = np.minimum(np.searchsorted(used, c), len(used) - 1)
                    mine = used[at] == c
                    hit = np.unique(r[mine])
                    # Records by terms by queries, in steps that stay small whatever the queries hold.
                    step = max(1, CELLS // len(used))
                    for low in range(0, len(hit), step):
                        some = hit[low : low + step]
                        inside = mine & (r >= some[0]) & (r <= some[-1])
                        block = np.zeros((len(some), len(used)))
                        block[np.searchsorted(some, r[inside]), at[inside]] = v[inside]
                        scores = np.round((block @ dense).T, 9)
                        best.add(np.where(scores > 0, scores, -np.inf), names[some], ties[some], first)
        for q, score, name, tie in best.rows():
            yield pd.DataFrame({"query_id": self.queries[q], "record": name, "tie": tie, "raw_score": score})


def keyword_candidates(queries: DataFrame, records: DataFrame, record: str, text: str, depth: str | int, tie: str | None = None, keep: DataFrame | None = None) -> DataFrame:
    """``query_id, record, raw_score, keyword_rank``: the best ``depth`` records of each query by BM25.

    ``depth`` is a number or a column of ``queries``. Only records that hold a
    term of the query score. Ties (in nine decimals) go by ``tie`` (a column of
    ``records``, null last) and record. With ``keep`` (``record``) only those
    are ranked, while statistics still cover all records.

    A record's terms are in one place, so it is scored where it is read against
    the queries' weights, and each task keeps the best of each query: what is
    shuffled are ``depth`` rows a query and task, and the counts of asked terms.
    Queries are searched in parts of about ``topk.BATCH``.
    """
    spark = records.sparkSession
    tie_column = F.col(tie) if tie else F.lit(None).cast("string")
    rows = records.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), tie_column.alias("tie"), F.col(text).alias("text"))
    if keep is not None:
        rows = rows.join(keep.select("record"), "record", "left_semi")
    kinds = StructType([queries.select("query_id").schema[0], *rows.select("record", "tie").schema.fields, StructField("raw_score", DoubleType())])
    parts = []
    for part in in_batches(queries.where(F.col("query_id").isNotNull()), "query_id"):
        weights, average = asked_weights(query_terms(part), records, record, text)
        if not len(weights):
            continue
        depths = {r[0]: r[1] or 1 for r in part.select("query_id", F.col(depth) if isinstance(depth, str) else F.lit(depth)).collect()}
        scorer = spark.sparkContext.broadcast(_Scorer(weights, average, depths))
        found = spread(rows).mapInPandas(lambda batches, scorer=scorer: scorer.value.read(batches), kinds)
        limits = spark.createDataFrame(list(depths.items()), StructType([kinds[0], StructField("depth", IntegerType())]))
        order = W.partitionBy("query_id").orderBy(F.desc("raw_score"), F.asc_nulls_last("tie"), F.asc("record"))
        ranked = found.withColumn("keyword_rank", F.row_number().over(order)).join(limits, "query_id").where(F.col("keyword_rank") <= F.greatest("depth", F.lit(1)))
        parts.append(ranked.select("query_id", "record", "raw_score", "keyword_rank"))
    if not parts:
        empty = StructType([kinds[0], kinds[1], kinds[3], StructField("keyword_rank", IntegerType())])
        return spark.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, parts)
