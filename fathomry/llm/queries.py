"""The package's named queries."""

from __future__ import annotations

from fathomry.llm import oracle
from fathomry.llm.bisect import split_oversized
from fathomry.llm.distinctive import distinctive_terms, one_row_per_record
from fathomry.llm.idealpoint import distinct_items, ideal_point_ranking, one_sided_groups
from fathomry.llm.leakage import leaks
from fathomry.llm.markup import label_texts
from fathomry.llm.mixing import mix, mix_report, plan_shares, with_tokens
from fathomry.llm.neighbours import most_similar
from fathomry.llm.truncation import truncated, truncation_report
from fathomry.functions.text import preview, terms, word_count
from fathomry.operators.vector import vector_candidates
from fathomry.plans.registry import Registry
from fathomry.session import settle, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

registry = Registry()


@registry.query("p1_found", oracle.P1_FOUND)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distinctive_terms(table(spark, sf_dir, "chunks"), "chunk_id", "content", "arrived_at", min_tf=3, min_df=2, max_df=12)
    return found.select(F.col("record").alias("chunk_id"), "term")


@registry.query("p1_top_terms", oracle.P1_TOP_TERMS)
def p1_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most distinctive terms of every chunk."""
    scored = distinctive_terms(table(spark, sf_dir, "chunks"), "chunk_id", "content", "arrived_at")
    best = F.row_number().over(W.partitionBy("record").orderBy(F.round("score", 9).desc(), "term"))
    return scored.withColumn("place", best).where("place <= 5").select(F.col("record").alias("chunk_id"), "term", "tf", "df", F.round("score", 6).alias("score"), "place")


@registry.query("p1_keyword_agreement", oracle.P1_KEYWORD_AGREEMENT)
def p1_keyword_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recorded keyword hit next to the sum of its query's term weights."""
    scored = distinctive_terms(table(spark, sf_dir, "chunks"), "chunk_id", "content", "arrived_at")
    hits = table(spark, sf_dir, "keyword_hits").select("query_id", "query_text", "chunk_id", "raw_score").distinct()
    asked = hits.withColumn("term", F.explode_outer(F.array_distinct(terms(F.col("query_text")))))
    joined = asked.join(scored.select(F.col("record").alias("chunk_id"), "term", "score"), ["chunk_id", "term"], "left")
    summed = joined.groupBy("query_id", "query_text", "chunk_id", "raw_score").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("term_score"))
    agrees = F.abs(F.col("raw_score") - F.col("term_score")) <= 0.01 * F.greatest(F.abs("raw_score"), F.lit(0.01))
    return summed.select("query_id", "query_text", "chunk_id", "raw_score", F.round("term_score", 6).alias("term_score"), agrees.alias("agrees"))


def neighbours_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return most_similar(table(spark, sf_dir, "chunk_vectors").select("chunk_id", "vector", "arrived_at"))


@registry.query("p3_found", oracle.P3_FOUND)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    close = neighbours_of_all(spark, sf_dir).where(F.col("cosine") >= 0.90)
    return close.select(F.least("item", "other").alias("chunk_a"), F.greatest("item", "other").alias("chunk_b")).distinct()


@registry.query("p3_neighbours")
def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours_of_all(spark, sf_dir).select(F.col("item").alias("chunk_id"), F.col("other").alias("neighbour"), F.round("cosine", 6).alias("cosine"))


@registry.query("p3_recall", oracle.P3_RECALL)
def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the embeddings whose id is divisible by 50: whether the index finds nine tenths of their ten nearest among all, as an exact search has them."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    # One more, as the record itself comes first.
    exact = vector_candidates(asked, vectors, "vec_id", "embedding", 11).where("query_id <> record").where("vector_rank <= 11").select(F.col("query_id").alias("item"), F.col("record").alias("other"))
    found = most_similar(vectors.withColumn("at", F.lit(0)), id_col="vec_id", vector="embedding", arrived="at").select("item", "other", F.lit(True).alias("found"))
    judged = exact.join(found, ["item", "other"], "left")
    return judged.agg(F.count_distinct("item").alias("n_queries"), (F.count_if("found") >= F.lit(0.9) * F.count(F.lit(1))).alias("reached"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunking_configs"))


@registry.query("p4_found", oracle.P4_FOUND)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark, sf_dir).where("piece = 0").select(F.col("record").alias("chunk_id"))


@registry.query("p4_invariants", oracle.P4_INVARIANTS)
def p4_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split chunk: its words without overlaps, and whether every piece keeps the limit and each but the first the overlap, as far as there is text for one."""
    found = pieces(spark, sf_dir).groupBy(F.col("record").alias("chunk_id"), "pieces").agg(
        F.sum(F.col("token_count") - F.col("overlap_count")).alias("words"), F.max("token_count").alias("most"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("piece") > 0, F.col("overlap_count"))).alias("overlap"),
    )
    configs = table(spark, sf_dir, "chunks").select("chunk_id", "config_name", word_count(F.col("content")).alias("words")).distinct().join(table(spark, sf_dir, "chunking_configs"), "config_name")
    limits = configs.groupBy("chunk_id", "words").agg(F.max("max_tokens").alias("max_tokens"), F.max("overlap_tokens").alias("overlap_tokens"))
    joined = found.join(limits, ["chunk_id", "words"])
    return joined.select("chunk_id", "words", (F.col("most") <= F.col("max_tokens")).alias("within"), (F.col("n") == F.col("pieces")).alias("complete"), (F.col("overlap") == F.col("overlap_tokens")).alias("overlaps")).distinct()


@registry.query("p4_pieces")
def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark, sf_dir).select(
        F.col("record").alias("chunk_id"), "piece", "pieces", F.array_join("heading_path", " > ").alias("heading_path"), "content", "token_count", "overlap_count", "boundary"
    )


SCORES = ["vector_score", "keyword_score"]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_items(table(spark, sf_dir, "explain_details"), "retrieval_run_id", "chunk_id", "arrived_at", ["rank", *SCORES, "fused_score"])


@registry.query("p5_found", oracle.P5_FOUND)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose recorded order is that of one normalised score alone; the raw scores of those are checked exactly."""
    found = one_sided_groups(results(spark, sf_dir), "rank", *SCORES)
    return found.select(F.col("grp").alias("retrieval_run_id")).distinct()


@registry.query("p5_ranking", oracle.P5_RANKING)
def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ideal_point_ranking(results(spark, sf_dir), SCORES).select(
        F.col("grp").alias("retrieval_run_id"), F.col("item").alias("chunk_id"), "rank", F.round("fused_score", 5).alias("fused_score"), F.round("closeness", 6).alias("closeness"), "ideal_rank"
    )


@registry.query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = label_texts(table(spark, sf_dir, "chunks"), "chunk_id", "content", cleaning=False)
    return labelled.select(F.col("record").alias("chunk_id"), F.explode("formats").alias("kind")).distinct()


@registry.query("p7_clean")
def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean content and the preview made from it, one row per chunk."""
    once = one_row_per_record(table(spark, sf_dir, "chunks"), "chunk_id", "content", "arrived_at")
    cleaned = label_texts(once, "record", "text")
    kinds = F.transform("blocks", lambda b: b["kind"])
    return cleaned.select(
        F.col("record").alias("chunk_id"), F.array_join("formats", " ").alias("formats"), "clean_text", preview(F.col("clean_text")).alias("clean_preview"),
        F.array_join(kinds, " ").alias("block_kinds"),
    )


def leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@registry.query("p8_found", oracle.P8_FOUND)
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(spark, sf_dir).select("doc_id", "item_id")


@registry.query("p8_items", oracle.P8_ITEMS)
def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation item: the documents that hold a passage, and how much of it at most."""
    found = leaked(spark, sf_dir)
    return found.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_documents"), F.max("shared_words").alias("most_shared_words"), F.max("item_words").alias("item_words"),
        F.count_if(F.col("shared_words") == F.col("item_words")).alias("n_whole"),
    )


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(with_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))


def shares_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sized_documents(spark, sf_dir)
    shares = plan_shares(sized, table(spark, sf_dir, "source_targets"))
    return mix_report(mix(sized, shares), shares)


@registry.query("p9_found", oracle.P9_FOUND)
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that the mix leaves short although it uses all they have as often as allowed."""
    return shares_reached(spark, sf_dir).where("short").select("source")


@registry.query("p9_shares", oracle.P9_SHARES)
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix per source. Whether its totals are met is told by bounds, as the tokens are the tokenizer's own."""
    given = shares_reached(spark, sf_dir)
    # Landing leaves at most a few documents; the bound is wide of that.
    met = F.abs(F.col("mixed_tokens") - F.least("wanted_tokens", (F.col("tokens") * F.col("max_repeats")).cast("double"))) <= 0.05 * F.col("wanted_tokens") + 2000
    return given.select("source", "target_share", "max_repeats", "documents", "short", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"), met.alias("met"), (F.col("mixed_tokens") > 0).alias("used"))


@registry.query("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sized_documents(spark, sf_dir)
    return mix(sized, plan_shares(sized, table(spark, sf_dir, "source_targets"))).withColumnRenamed("record", "doc_id")


def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents"))


@registry.query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_documents(spark, sf_dir).where("truncated").select(F.col("record").alias("doc_id"))


@registry.query("p10_sources")
def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_report(judged_documents(spark, sf_dir))
