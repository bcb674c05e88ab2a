"""Retrieval quality: judging results against expected chunks and files, and its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.functions.paths import path_matches
from fathomry.functions.scoring import THRESHOLD, hit_at, reciprocal_rank

# Fixed value: questions are searched at least this deep, so that hit@5 means something.
LEAST_DEPTH = 5


def has_ground_truth(questions: DataFrame) -> DataFrame:
    """Questions with at least one expected chunk or file."""
    size = lambda name: F.coalesce(F.size(name), F.lit(0))
    return questions.where((size("expected_chunk_ids") > 0) | (size("expected_source_files") > 0))


def judge(questions: DataFrame, results: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row per question: first relevant rank, hits, reciprocal rank, top score, and what was returned.

    ``questions``: ``question_id, expected_chunk_ids, expected_source_files``;
    ``results``: ``query_id, rank, chunk_id, source_path, score``, whose query is
    the question. A result is relevant if its chunk or, tolerantly, its file is
    expected. A question without results is empty, not missing. With ``runs``
    (``query_id, latency_ms, retrieval_run_id``) each question has those of its run.
    """
    asked = questions.select(
        F.col("question_id").cast("string").alias("question_id"),
        F.coalesce("expected_chunk_ids", F.array().cast("array<string>")).alias("expected_chunk_ids"),
        F.coalesce("expected_source_files", F.array().cast("array<string>")).alias("expected_source_files"),
    )
    joined = asked.join(results.withColumnRenamed("query_id", "question_id"), "question_id", "left")
    relevant = F.coalesce(F.array_contains("expected_chunk_ids", F.col("chunk_id")), F.lit(False)) | F.coalesce(
        F.exists("expected_source_files", lambda e: path_matches(F.col("source_path"), e)), F.lit(False)
    )
    listed = F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "chunk_id", "source_path"))))
    judged = joined.groupBy("question_id").agg(
        F.min(F.when(relevant, F.col("rank"))).alias("first_rank"), F.min_by("score", "rank").alias("top_score"), F.count("rank").alias("n_results"), listed.alias("listed")
    )
    extra = []
    if runs is not None:
        judged = judged.join(runs.select(F.col("query_id").cast("string").alias("question_id"), "retrieval_run_id", "latency_ms"), "question_id", "left")
        extra = ["retrieval_run_id", "latency_ms"]
    return judged.select(
        "question_id",
        "first_rank",
        hit_at(F.col("first_rank"), 1).alias("hit_at_1"),
        hit_at(F.col("first_rank"), 3).alias("hit_at_3"),
        hit_at(F.col("first_rank"), 5).alias("hit_at_5"),
        reciprocal_rank(F.col("first_rank")).alias("reciprocal_rank"),
        "top_score",
        (F.col("n_results") == 0).alias("empty"),
        F.transform("listed", lambda x: x["chunk_id"]).alias("returned_chunk_ids"),
        F.transform("listed", lambda x: x["source_path"]).alias("returned_source_paths"),
        *extra,
    )


def metrics(judged: DataFrame, mode: str) -> DataFrame:
    """One row of metrics; all zero without questions. An empty result counts as below the threshold in every mode. Latencies, where judged, are averaged."""
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    below = F.col("empty") | (F.col("top_score") < THRESHOLD) if mode == "vector" else F.col("empty")
    return judged.agg(
        F.count(F.lit(1)).alias("question_count"), share("hit_at_1").alias("hit_at_1"), share("hit_at_3").alias("hit_at_3"), share("hit_at_5").alias("hit_at_5"),
        share("reciprocal_rank").alias("mrr"), F.count_if("empty").alias("empty_count"), F.count_if(F.coalesce(below, F.lit(False))).alias("below_threshold_count"),
        *([share("latency_ms").alias("avg_latency_ms")] if "latency_ms" in judged.columns else []),
    )


def gate(measured: DataFrame, fail_below: float | None) -> DataFrame:
    """Adds ``status``: ``failed_threshold`` if hit@3 is strictly below the bound, else ``completed``."""
    status = F.when(F.col("hit_at_3") < F.lit(fail_below), "failed_threshold").otherwise("completed") if fail_below is not None else F.lit("completed")
    return measured.withColumn("status", status)
