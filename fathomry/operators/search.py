"""Batched search in vector, keyword and hybrid mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomry.functions.scoring import clears_threshold, explanation, fetch_depth, filter_text, fused_score, hybrid_depth, keyword_share
from fathomry.functions.vectors import similarity
from fathomry.operators.filters import is_filtered, passes
from fathomry.operators.keyword import keyword_candidates
from fathomry.operators.vector import vector_candidates

MODES = ("vector", "keyword", "hybrid")


class ModelMismatch(ValueError):
    """The index was made with another embedding model than the query."""


class EmptyQuery(ValueError):
    """A query without any text."""


def complete_queries(queries: DataFrame, mode: str, top_k: int, skip_blank: bool = False) -> DataFrame:
    """Queries with every optional column present, and the depth to fetch.

    Raises on a bad mode or top_k, and on null and blank texts unless they are to be skipped.
    """
    if mode not in MODES:
        raise ValueError(f"unknown search mode {mode!r}; one of {MODES}")
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    kinds = {"project": "string", "tags": "array<string>", "source": "string"}
    for name, kind in kinds.items():
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    filtered = is_filtered(F.col("project"), F.col("tags"), F.col("source"))
    depth = hybrid_depth(top_k, filtered) if mode == "hybrid" else fetch_depth(top_k, filtered)
    blank = ~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    if not skip_blank:
        empty = queries.where(blank).select(F.col("query_id").cast("string")).first()
        if empty is not None:
            raise EmptyQuery(f"query {empty[0]} is empty")
    kept = queries.where(~blank)
    return kept.withColumn("query_id", F.col("query_id").cast("string")).withColumn("filtered", filtered).withColumn("depth", depth.cast("int"))


def indexed_models(documents: DataFrame) -> DataFrame:
    """Models of the documents that are not deleted, the first (by source path) on top; more than one means a mixed index."""
    live = documents.where(F.coalesce(F.col("status") != "Deleted", F.lit(True)))
    return live.groupBy("embedding_model", "embedding_dimension").agg(F.min("source_path").alias("first_path"), F.count(F.lit(1)).alias("n_documents")).orderBy("first_path")


def check_model(documents: DataFrame, name: str, dimension: int) -> None:
    """Raise if the index was made with another model. An empty index is no error."""
    first = indexed_models(documents).first()
    if first and (first.embedding_model, first.embedding_dimension) != (name, dimension):
        raise ModelMismatch(f"the index has {first.embedding_model} ({first.embedding_dimension}), the query {name} ({dimension})")


def check_vectors(queries: DataFrame, dimension: int) -> None:
    """Raise if a query's vector is missing or has another length than the index."""
    odd = queries.where(~F.coalesce(F.size("vector") == dimension, F.lit(False))).select(F.col("query_id").cast("string"), F.size("vector")).first()
    if odd is not None:
        raise ValueError(f"the vector of query {odd[0]} has {odd[1]} values, the index {dimension}")


def search(
    queries: DataFrame, chunks: DataFrame, documents: DataFrame, mode: str, top_k: int, vectors: DataFrame | None = None, exact_filter: bool = False, explain: bool = False,
    model: tuple[str, int] | None = None, skip_blank: bool = False,
) -> DataFrame:
    """``query_id, rank, chunk_id, document_id, source_path, score, preview, heading_path, vector_score, keyword_score`` (and ``reason``).

    ``queries``: ``query_id, text`` and, as needed, ``vector, project, tags,
    source``; ``chunks`` has one row per chunk (``chunk_id, document_id,
    source_path, content, preview, heading_path``), ``documents`` one per
    document (``id, project, tags, status``), ``vectors`` ``chunk_id, vector``.

    Filters apply after the candidates were cut, so that a filtered query may
    find fewer than ``top_k``; with ``exact_filter`` they apply before, for a
    batch whose queries all have the same filter (one row, which meets every chunk's document). Chunks without their document are dropped. Order: score, vector rank, keyword rank,
    source path, chunk id. An empty index gives no rows.

    An empty question is an error unless ``skip_blank``. With ``model``, the name
    and dimension of what made the queries' vectors, an index made by another
    model and a vector of another length are errors in the modes that use vectors.
    """
    asked = complete_queries(queries, mode, top_k, skip_blank)
    if model is not None and mode != "keyword":
        check_model(documents, *model)
        check_vectors(asked, model[1])
    docs = documents.select(F.col("id").alias("document_id"), F.col("project").alias("doc_project"), F.col("tags").alias("doc_tags"), "status")
    meta = chunks.select("chunk_id", "document_id", "source_path", "preview", "heading_path")
    allowed = passes(F.col("status"), F.col("doc_project"), F.col("doc_tags"), F.col("source_path"), F.col("project"), F.col("tags"), F.col("source"))
    keep = None
    if exact_filter:
        one = asked.select("project", "tags", "source").distinct().limit(2)
        if one.count() > 1:
            raise ValueError("filtering before the cut takes one filter for the whole batch")
        keep = meta.join(docs, "document_id").join(one, allowed).select(F.col("chunk_id").alias("record"))
        vectors = vectors.join(keep.withColumnRenamed("record", "chunk_id"), "chunk_id", "left_semi") if vectors is not None else None
    merged = None
    if mode != "keyword":
        if vectors is None:
            raise ValueError("vector search needs vectors")
        hits = vector_candidates(asked, vectors, "chunk_id", "vector", "depth")
        merged = hits.select("query_id", F.col("record").alias("chunk_id"), "vector_rank", similarity(F.col("distance")).alias("vector_score"))
        merged = merged.withColumn("n_vector", F.count(F.lit(1)).over(W.partitionBy("query_id")))
    if mode != "vector":
        hits = keyword_candidates(asked, chunks, "chunk_id", "content", "depth", tie="source_path", keep=keep)
        best = F.max("raw_score").over(W.partitionBy("query_id"))
        words = hits.select("query_id", F.col("record").alias("chunk_id"), "keyword_rank", keyword_share(F.col("raw_score"), best).alias("keyword_score"))
        words = words.withColumn("n_keyword", F.count(F.lit(1)).over(W.partitionBy("query_id")))
        merged = words if merged is None else merged.join(words, ["query_id", "chunk_id"], "full_outer")
    for name, kind in (("vector_rank", "int"), ("vector_score", "double"), ("n_vector", "long"), ("keyword_rank", "int"), ("keyword_score", "double"), ("n_keyword", "long")):
        if name not in merged.columns:
            merged = merged.withColumn(name, F.lit(None).cast(kind))
    score = {"vector": F.col("vector_score"), "keyword": F.col("keyword_score"), "hybrid": fused_score(F.col("vector_rank"), F.col("keyword_rank"))}[mode]
    found = merged.join(meta, "chunk_id").join(docs, "document_id").join(asked.select("query_id", "project", "tags", "source", "filtered"), "query_id").where(allowed)
    order = W.partitionBy("query_id").orderBy(
        F.round("score", 9).desc(), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"), F.asc("source_path"), F.asc("chunk_id")
    )
    ranked = found.withColumn("score", F.coalesce(score, F.lit(0.0))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    columns = ["query_id", "rank", "chunk_id", "document_id", "source_path", "score", "preview", "heading_path", "vector_score", "keyword_score"]
    if explain:
        widest = lambda name: F.coalesce(F.col(name), F.max(name).over(W.partitionBy("query_id")), F.lit(0))
        ranked = ranked.withColumn("reason", explanation(F.col("vector_rank"), widest("n_vector"), F.col("keyword_rank"), widest("n_keyword"), F.col("filtered")))
        columns.append("reason")
    return ranked.select(*columns)


def run_summary(queries: DataFrame, results: DataFrame, mode: str) -> DataFrame:
    """One row per query: results found, and those below the similarity threshold."""
    counted = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"), F.count_if(~clears_threshold(mode, F.col("score"))).alias("below_threshold"))
    joined = queries.select(F.col("query_id").cast("string").alias("query_id")).join(counted, "query_id", "left")
    return joined.select("query_id", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("below_threshold", F.lit(0)).alias("below_threshold"))


RESULT_COLUMNS = ["rank", "chunk_id", "document_id", "source_path", "score", "preview", "heading_path"]


def run_records(queries: DataFrame, results: DataFrame, documents: DataFrame, mode: str, top_k: int, latency_ms: float, completed_at: str) -> DataFrame:
    """One record per query of a finished search.

    ``retrieval_run_id`` (a column of ``queries``, else made from the query's id
    and the time), ``query_id, question_text, search_mode, top_k, filters,
    results`` by rank, ``latency_ms`` (the batch's time, shared by its queries), ``below_threshold_count,
    reason`` and ``completed_at``. ``reason`` tells an empty index
    (``indexEmpty``, no document that is not deleted) from a search that found
    nothing (``ok``).
    """
    empty = documents.where(F.coalesce(F.col("status") != "Deleted", F.lit(True))).isEmpty()
    listed = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(*RESULT_COLUMNS))).alias("results"), F.count_if(~clears_threshold(mode, F.col("score"))).alias("below_threshold_count")
    )
    named = queries.withColumn("query_id", F.col("query_id").cast("string"))
    run = F.col("retrieval_run_id") if "retrieval_run_id" in queries.columns else F.concat(F.lit("rrun_"), F.substring(F.sha2(F.concat_ws(":", "query_id", F.lit(completed_at)), 256), 1, 16))
    part = lambda name, kind: F.col(name) if name in queries.columns else F.lit(None).cast(kind)
    none = F.array().cast(dict(listed.dtypes)["results"])
    joined = named.join(listed, "query_id", "left")
    return joined.select(
        run.alias("retrieval_run_id"), "query_id", F.col("text").alias("question_text"), F.lit(mode).alias("search_mode"), F.lit(top_k).alias("top_k"),
        filter_text(part("project", "string"), part("tags", "array<string>"), part("source", "string")).alias("filters"), F.coalesce("results", none).alias("results"),
        F.lit(float(latency_ms)).alias("latency_ms"), F.coalesce("below_threshold_count", F.lit(0)).alias("below_threshold_count"),
        F.lit("indexEmpty" if empty else "ok").alias("reason"), F.lit(completed_at).alias("completed_at"),
    )
