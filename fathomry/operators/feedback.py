"""Relevance feedback: recording it against run evidence, and reports on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATINGS = ("good", "bad")
# Fixed value: distinct downvoted chunks that make a document a candidate for other chunking.
RECHUNK_AT = 2
MODES = ("vector", "keyword", "hybrid")


class RejectedFeedback(ValueError):
    """The whole batch is refused; ``problems`` are its first few."""

    def __init__(self, problems: list[tuple[str, str]]):
        super().__init__("; ".join(f"{i}: {p}" for i, p in problems))
        self.problems = problems


def latest_runs(evidence: DataFrame, key: str, order: str = "created_at") -> DataFrame:
    """The latest row of each key, of equal times the greatest run id."""
    newest = F.max_by(F.struct(*evidence.columns), F.struct(order, "retrieval_run_id")).alias("row")
    return evidence.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(newest).select("row.*")


def judged_inputs(inputs: DataFrame, evidence: DataFrame, stored: DataFrame) -> DataFrame:
    """Every input with what its run showed, and ``problem`` (null if it may be stored).

    ``inputs``: ``id, query_id, retrieval_run_id, chunk_id, rating, note,
    created_at``; ``evidence`` has one row per run.
    """
    runs = evidence.select(
        F.col("retrieval_run_id"), F.col("query_id").alias("run_query"), "search_mode", F.col("question_text"), F.col("results")
    )
    repeated = inputs.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    known = stored.select("id").distinct().withColumn("stored", F.lit(True))
    joined = inputs.join(repeated, "id", "left").join(known, "id", "left").join(runs, "retrieval_run_id", "left")
    shown = joined.withColumn("shown", F.get(F.filter("results", lambda r: r["chunk_id"] == F.col("chunk_id")), F.lit(0)))
    problem = (
        F.when(F.col("id").isNull(), "feedback without id")
        .when(F.col("times") > 1, "feedback id appears more than once in this batch")
        .when(F.col("stored"), "feedback id already exists")
        .when(~F.coalesce(F.col("rating").isin(*RATINGS), F.lit(False)), "unknown rating")
        .when(F.col("run_query").isNull(), "retrieval run was not found")
        .when(~F.col("run_query").eqNullSafe(F.col("query_id")), "query id does not match the run")
        .when(F.col("shown").isNull(), "chunk was not displayed in the run")
    )
    return shown.select(
        "id", "query_id", "retrieval_run_id", "chunk_id", F.col("shown.document_id").alias("document_id"), "rating", "note", "search_mode",
        F.col("shown.rank").alias("rank"), F.col("shown.score").alias("score"), F.col("shown.source_path").alias("source_path"), "question_text", "created_at",
        problem.alias("problem"),
    )


def record_feedback(inputs: DataFrame, evidence: DataFrame, stored: DataFrame) -> DataFrame:
    """The items to append, all or nothing: one bad input refuses the batch."""
    judged = judged_inputs(inputs, evidence, stored)
    bad = judged.where(F.col("problem").isNotNull()).select("id", "problem").limit(5).collect()
    if bad:
        raise RejectedFeedback([(str(r.id), r.problem) for r in bad])
    return judged.drop("problem")


def select_feedback(items: DataFrame, since: str | None = None, until: str | None = None, rating: str | None = None) -> DataFrame:
    """Items within inclusive bounds and of one rating, in order of time and id."""
    kept = items
    if since is not None:
        kept = kept.where(F.col("created_at") >= F.lit(since))
    if until is not None:
        kept = kept.where(F.col("created_at") <= F.lit(until))
    if rating is not None:
        kept = kept.where(F.col("rating") == rating)
    return kept.orderBy("created_at", "id")


def by_query(items: DataFrame) -> DataFrame:
    """Per query: good and bad ratings, the first question text that is not empty, and the modes in a fixed order."""
    place = F.struct("created_at", "id")
    modes = F.array_sort(F.collect_set(F.array_position(F.array(*map(F.lit, MODES)), F.col("search_mode"))))
    named = F.transform(F.filter(modes, lambda m: m > 0), lambda m: F.get(F.array(*map(F.lit, MODES)), (m - 1).cast("int")))
    text = F.when(F.length("question_text") > 0, F.col("question_text"))
    return items.groupBy("query_id").agg(
        F.min_by(text, F.when(text.isNotNull(), place)).alias("question_text"), F.array_join(named, ",").alias("search_modes"),
        F.count_if(F.col("rating") == "bad").alias("bad_count"), F.count_if(F.col("rating") == "good").alias("good_count"),
    ).withColumn("question_text", F.coalesce("question_text", F.lit("")))


def problem_queries(items: DataFrame) -> DataFrame:
    total = F.col("bad_count") + F.col("good_count")
    return by_query(items).where("bad_count > 0").withColumn("bad_ratio", F.col("bad_count") / total).orderBy(F.desc("bad_ratio"), F.desc("bad_count"), "query_id")


def downvoted_chunks(items: DataFrame) -> DataFrame:
    """Chunks with bad ratings; document and path are the last ones given."""
    last = F.struct("created_at", "id")
    return (
        items.where(F.col("rating") == "bad").groupBy("chunk_id")
        .agg(
            F.max_by(F.coalesce("document_id", F.lit("")), last).alias("document_id"), F.max_by(F.coalesce("source_path", F.lit("")), last).alias("source_path"),
            F.count(F.lit(1)).alias("bad_count"), F.count_distinct("query_id").alias("distinct_query_count"),
        )
        .orderBy(F.desc("bad_count"), F.desc("distinct_query_count"), "chunk_id")
    )


def queries_without_good(items: DataFrame) -> DataFrame:
    counted = by_query(items).where("good_count = 0 and bad_count > 0")
    return counted.select("query_id", "question_text", F.col("bad_count").alias("total_feedback"), "good_count").orderBy(F.desc("total_feedback"), "query_id")


def rechunk_candidates(items: DataFrame, least: int = RECHUNK_AT) -> DataFrame:
    """Documents in which at least ``least`` distinct chunks were downvoted."""
    bad = items.where((F.col("rating") == "bad") & F.col("document_id").isNotNull())
    counted = bad.groupBy("document_id").agg(
        F.max_by(F.coalesce("source_path", F.lit("")), F.struct("created_at", "id")).alias("source_path"), F.count_distinct("chunk_id").alias("downvoted_chunk_count")
    ).where(F.col("downvoted_chunk_count") >= least)
    reason = F.format_string("%d distinct chunks in this document received bad feedback", "downvoted_chunk_count")
    return counted.withColumn("reason", reason).orderBy(F.desc("downvoted_chunk_count"), "document_id")


OBSERVED = ["query_id", "retrieval_run_id", "chunk_id", "rating", "search_mode", "rank", "score", "source_path", "created_at"]


def observations(items: DataFrame) -> DataFrame:
    """Every item as the report lists it, in order of time and id."""
    return items.orderBy("created_at", "id").select(F.col("id").alias("feedback_id"), *OBSERVED)
