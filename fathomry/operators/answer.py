"""Answers with citations: budgeted context, prompts, citation checks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomry.functions.scoring import clears_threshold
from fathomry.functions.text import word_count

# Fixed values of the prompt protocol.
TEMPLATE_VERSION = "v1.0.0"
CONTEXT_TEMPLATE = "Sources:\n{{chunks}}\n\nQuestion: {{question}}"
INSTRUCTIONS = (
    "Answer concisely. Cite every source you use by its chunk id. End your reply "
    "with a line `SOURCES: <comma-separated chunk ids>` listing only the sources you used."
)
CITED_BY_DEFAULT = 3


class LanguageModel(Protocol):
    """Called per Arrow batch on the executors; must be picklable."""

    provider: str

    def complete(self, messages: list[str]) -> list[tuple[str, list[str]]]:
        """Answer text and cited chunk ids of each message."""


def context(results: DataFrame, mode: str, max_tokens: int, text: str = "preview") -> DataFrame:
    """The best-ranked results of each query that fit the budget, at least one; weak results are left out first."""
    strong = results.where(clears_threshold(mode, F.col("score"))).withColumn("tokens", F.coalesce(word_count(F.col(text)), F.lit(0)))
    order = W.partitionBy("query_id").orderBy("rank")
    running = F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0))
    return strong.withColumn("running_tokens", running).withColumn("place", F.row_number().over(order)).where((F.col("running_tokens") <= max_tokens) | (F.col("place") == 1)).drop("place")


def tagged(chunk: Column, source: Column, heading: Column, text: Column) -> Column:
    """A chunk as it stands in a prompt."""
    path = F.when(F.coalesce(F.size(heading), F.lit(0)) > 0, F.concat(F.lit(" ["), F.array_join(heading, " > "), F.lit("]"))).otherwise("")
    return F.concat(F.lit("[[chunk:"), chunk, F.lit("]] (source="), source, F.lit(")"), path, F.lit("\n"), text)


def prompts(questions: DataFrame, contexts: DataFrame, text: str = "preview") -> DataFrame:
    """``query_id, message``: chunks fill the template first, then the question, so a chunk that quotes the placeholder gets it too."""
    shown = contexts.select("query_id", "rank", tagged(F.col("chunk_id"), F.col("source_path"), F.col("heading_path"), F.col(text)).alias("block"))
    blocks = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("blocks"))
    joined = blocks.join(questions.select(F.col("query_id").cast("string").alias("query_id"), F.col("text").alias("question")), "query_id")
    filled = F.replace(F.lit(CONTEXT_TEMPLATE), F.lit("{{chunks}}"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n"))
    return joined.select("query_id", F.concat(F.replace(filled, F.lit("{{question}}"), F.col("question")), F.lit("\n\n"), F.lit(INSTRUCTIONS)).alias("message"))


def tagged_ids(message: Column) -> Column:
    """Chunk ids tagged in a message, in order, once each."""
    return F.array_distinct(F.filter(F.regexp_extract_all(message, F.lit(r"(?s)\[\[chunk:(.*?)\]\]"), F.lit(1)), lambda x: x != ""))


# The words of the reply that stands in for a model's.
OFFLINE_REPLY = ("Based on the retrieved documentation, here is an answer grounded in ", " source(s). See the cited sources for details.")


def offline_replies(prompted: DataFrame, most: int = CITED_BY_DEFAULT) -> DataFrame:
    """``query_id, reply, cited, provider`` without a model: cites the first tagged chunks and says how many."""
    cited = F.slice(tagged_ids(F.col("message")), 1, most)
    words = F.concat(F.lit(OFFLINE_REPLY[0]), F.size("cited").cast("string"), F.lit(OFFLINE_REPLY[1]))
    return prompted.select("query_id", cited.alias("cited")).select("query_id", F.when(F.size("cited") > 0, words).otherwise("").alias("reply"), "cited", F.lit("mock-llm").alias("provider"))


def model_replies(prompted: DataFrame, model: LanguageModel) -> DataFrame:
    """``query_id, reply, cited, provider`` from a model, called batch by batch; a failing batch gives null replies."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                replies = model.complete(list(batch["message"]))
            except Exception:  # noqa: BLE001 - whatever a provider raises, the batch has no answers
                replies = [(None, [])] * len(batch)
            yield pd.DataFrame({"query_id": batch["query_id"], "reply": [r[0] for r in replies], "cited": [list(r[1]) for r in replies], "provider": model.provider})

    return prompted.select("query_id", "message").mapInPandas(each, "query_id string, reply string, cited array<string>, provider string")


def answers(questions: DataFrame, results: DataFrame, replies: DataFrame) -> DataFrame:
    """One row per question: the answer with its citations, or the reason there is none.

    Without a reply nothing cleared the threshold; a null reply is a provider's
    error; an empty one, or one that cites none of the query's results, is
    outside the corpus. Citations are checked against all results of the query
    and come in rank order; results not cited are listed as unused.
    """
    listed = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "source_path"))).alias("results"))
    asked = questions.select(F.col("query_id").cast("string").alias("query_id"), F.col("text").alias("query_text"))
    none = F.array().cast("array<struct<rank:int,chunk_id:string,source_path:string>>")
    joined = asked.join(listed, "query_id", "left").join(replies.withColumn("replied", F.lit(True)), "query_id", "left").withColumn("results", F.coalesce("results", none))
    grounded = F.filter("results", lambda r: F.coalesce(F.array_contains("cited", r["chunk_id"]), F.lit(False)))
    reason = (
        F.when(F.col("replied").isNull(), "belowSimilarityThreshold")
        .when(F.col("reply").isNull(), "llmProviderError")
        .when((F.trim("reply") == "") | (F.size(grounded) == 0), "outsideCorpus")
    )
    shown = joined.withColumn("no_answer_reason", reason).withColumn("citations", F.when(reason.isNull(), grounded).otherwise(none))
    unused = F.array_except(F.transform("results", lambda r: r["chunk_id"]), F.transform("citations", lambda r: r["chunk_id"]))
    return shown.select(
        "query_id", "query_text", F.lit(TEMPLATE_VERSION).alias("prompt_template_version"), F.when(reason.isNull(), F.trim("reply")).alias("answer_text"),
        "citations", unused.alias("retrieved_but_unused_chunks"), "no_answer_reason", F.coalesce("provider", F.lit("none")).alias("llm_provider"),
    )


def broken_answers(answered: DataFrame) -> DataFrame:
    """Answers that break the invariant: a reason is given, or citations are there."""
    return answered.where(F.col("no_answer_reason").isNull() & (F.coalesce(F.size("citations"), F.lit(0)) == 0))
