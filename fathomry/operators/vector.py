"""Vector search: exact cosine of a batch of queries against all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomry.operators.topk import CELLS, Best, in_batches
from fathomry.session import spread

FOUND = "query_id string, record string, distance double"


def _matrix(values: list) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in values]).reshape(len(values), -1)
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


class _Scorer:
    """Cosine distances of a part of the queries to the vectors of a task."""

    def __init__(self, names: list[str], vectors: list, depths: list[int]):
        self.names, self.queries, self.depths = np.array(names, dtype=object), _matrix(vectors), np.array(depths, np.int64)

    def read(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, dimension = Best(self.depths), self.queries.shape[1]
        for batch in batches:
            good = [v is not None and len(v) == dimension and bool(np.isfinite(np.asarray(v, np.float64)).all()) for v in batch["vector"]]
            rows = batch[good]
            if not len(rows):
                continue
            records, unit = rows["record"].to_numpy(object), _matrix(list(rows["vector"])).T
            ties, step = np.full(len(records), None, object), max(1, CELLS // len(records))
            for first in range(0, len(self.queries), step):
                best.add(-np.round(1.0 - self.queries[first : first + step] @ unit, 9), records, ties, first)
        for q, score, name, _ in best.rows():
            yield pd.DataFrame({"query_id": self.names[q], "record": name, "distance": -score + 0.0})

    def __len__(self) -> int:
        return len(self.names)


def vector_candidates(queries: DataFrame, vectors: DataFrame, record: str, vector: str, depth: str | int, query: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """``query_id, record, distance, vector_rank``: the nearest ``depth`` records of each query, by cosine distance.

    Every block of vectors is scored by one matrix product, and each task keeps
    the nearest ones of each query over all its blocks: what is shuffled are
    ``depth`` rows a query and task. Queries are searched in parts of about
    ``topk.BATCH``; their vectors must have one length. Null vectors and those
    of another length or with non-finite values are not found; an all-zero
    vector has distance 1. Ties (in nine decimals) go by record.
    """
    spark = vectors.sparkSession
    depth_column = F.col(depth) if isinstance(depth, str) else F.lit(depth)
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query).cast("string").alias("q"), F.col(query_vector).alias("v"), F.greatest(F.coalesce(depth_column.cast("int"), F.lit(1)), F.lit(1)).alias("d"))
    sizes = [r[0] for r in asked.select(F.size("v")).distinct().limit(5).collect()]
    if len(sizes) > 1:
        raise ValueError(f"query vectors of different lengths: {sorted(sizes)}")
    if not sizes:
        return spark.createDataFrame([], FOUND + ", vector_rank int")
    rows = vectors.where(F.col(record).isNotNull()).select(F.col(record).cast("string").alias("record"), F.col(vector).alias("vector"))
    parts = []
    for part in in_batches(asked, "q"):
        held = part.collect()
        if not held:
            continue
        scorer = spark.sparkContext.broadcast(_Scorer([r.q for r in held], [r.v for r in held], [r.d for r in held]))
        limits = spark.createDataFrame([(r.q, r.d) for r in held], "query_id string, depth int")
        found = spread(rows).mapInPandas(lambda batches, scorer=scorer: scorer.value.read(batches), FOUND)
        order = W.partitionBy("query_id").orderBy("distance", "record")
        ranked = found.withColumn("vector_rank", F.row_number().over(order)).join(limits, "query_id").where(F.col("vector_rank") <= F.col("depth"))
        parts.append(ranked.drop("depth"))
    return reduce(DataFrame.unionByName, parts)
