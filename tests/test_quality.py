from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fathomry.operators import answer, evaluate, feedback

RESULTS = "query_id string, rank int, chunk_id string, source_path string, score double, preview string, heading_path array<string>"
T = [dt.datetime(2025, 1, d) for d in range(1, 9)]


@pytest.fixture(scope="module")
def results(spark):
    rows = [("q1", 1, "c1", "docs/a.md", 0.9, "one two three", ["A", "B"]), ("q1", 2, "c2", "docs/b.md", 0.5, "four five", []), ("q1", 3, "c3", "x/c.md", 0.1, "six", None), ("q2", 1, "c9", "docs/z.md", 0.2, "weak", [])]
    return spark.createDataFrame(rows, RESULTS)


def test_judgement(spark, results):
    questions = spark.createDataFrame(
        [("q1", ["c2"], []), ("q2", [], ["z.md"]), ("q3", ["c1"], None), ("q4", None, None)], "question_id string, expected_chunk_ids array<string>, expected_source_files array<string>"
    )
    judged = {r.question_id: r for r in evaluate.judge(evaluate.has_ground_truth(questions), results).collect()}
    assert set(judged) == {"q1", "q2", "q3"}
    assert (judged["q1"].first_rank, judged["q1"].hit_at_1, judged["q1"].hit_at_3, judged["q1"].reciprocal_rank) == (2, False, True, 0.5)
    assert judged["q1"].returned_chunk_ids == ["c1", "c2", "c3"] and judged["q2"].hit_at_1 and judged["q3"].empty
    m = evaluate.metrics(evaluate.judge(questions, results), "vector").first()
    assert (m.question_count, m.empty_count, m.below_threshold_count) == (4, 2, 3) and m.mrr == pytest.approx(1.5 / 4)
    runs = spark.createDataFrame([("q1", "r1", 10.0), ("q2", "r2", 30.0)], "query_id string, retrieval_run_id string, latency_ms double")
    timed = evaluate.judge(questions.where("question_id < 'q3'"), results, runs)
    assert evaluate.metrics(timed, "vector").first().avg_latency_ms == 20.0 and {r.question_id: r.retrieval_run_id for r in timed.collect()} == {"q1": "r1", "q2": "r2"}
    none = evaluate.metrics(evaluate.judge(questions.limit(0), results), "vector").first()
    assert none.question_count == 0 and none.mrr == 0.0


@pytest.mark.parametrize("hit,least,status", [(0.80, 0.80, "completed"), (0.79, 0.80, "failed_threshold"), (0.0, None, "completed")])
def test_gate(spark, hit, least, status):
    assert evaluate.gate(spark.createDataFrame([(hit,)], "hit_at_3 double"), least).first().status == status


def test_context_budget(results):
    assert [r.chunk_id for r in answer.context(results, "vector", 4).orderBy("rank").collect()] == ["c1"]
    assert {r.chunk_id for r in answer.context(results, "vector", 5).collect()} == {"c1", "c2"}
    assert {r.chunk_id for r in answer.context(results, "vector", 1).collect()} == {"c1"}
    assert {r.chunk_id for r in answer.context(results, "keyword", 99).collect()} == {"c1", "c2", "c3", "c9"}


def test_prompt_and_answers(spark, results):
    questions = spark.createDataFrame([("q1", "why?"), ("q2", "what?"), ("q3", "none")], "query_id string, text string")
    prompted = answer.prompts(questions, answer.context(results, "vector", 99))
    message = prompted.first().message
    assert message.startswith("Sources:\n[[chunk:c1]] (source=docs/a.md) [A > B]\none two three\n\n[[chunk:c2]] (source=docs/b.md)\nfour five\n\nQuestion: why?\n\n")
    replies = answer.offline_replies(prompted)
    got = {r.query_id: r for r in answer.answers(questions, results, replies).collect()}
    assert [c.chunk_id for c in got["q1"].citations] == ["c1", "c2"] and got["q1"].retrieved_but_unused_chunks == ["c3"] and got["q1"].no_answer_reason is None
    assert got["q2"].no_answer_reason == got["q3"].no_answer_reason == "belowSimilarityThreshold" and got["q2"].retrieved_but_unused_chunks == ["c9"]
    assert answer.broken_answers(answer.answers(questions, results, replies)).count() == 0
    odd = spark.createDataFrame([("q1", "text", ["invented", "c3", "c1", "c1"], "m"), ("q2", None, [], "m"), ("q3", " ", ["c1"], "m")], "query_id string, reply string, cited array<string>, provider string")
    got = {r.query_id: r for r in answer.answers(questions, results, odd).collect()}
    assert [c.chunk_id for c in got["q1"].citations] == ["c1", "c3"]
    assert got["q2"].no_answer_reason == "llmProviderError" and got["q3"].no_answer_reason == "outsideCorpus"


def test_tags_in_messages(spark):
    df = spark.createDataFrame([("[[chunk:]][[chunk:a]] x [[chunk:b]] [[chunk:a]] [[chunk:open",)], "m string")
    assert df.select(answer.tagged_ids(F.col("m"))).first()[0] == ["a", "b"]


class Model:
    provider = "test"

    def complete(self, messages):
        if any("boom" in m for m in messages):
            raise RuntimeError("down")
        return [("fine", ["c1"])] * len(messages)


def test_models(spark):
    good = spark.createDataFrame([("q", "m")], "query_id string, message string").coalesce(1)
    assert answer.model_replies(good, Model()).first().cited == ["c1"]
    assert answer.model_replies(good.withColumn("message", F.lit("boom")), Model()).first().reply is None


FEEDBACK = "id string, query_id string, retrieval_run_id string, chunk_id string, document_id string, rating string, search_mode string, source_path string, question_text string, created_at timestamp"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [
            ("1", "qa", "r", "cb", "d", "bad", "hybrid", "p1", "", T[0]), ("2", "qa", "r", "cb", "d", "bad", "vector", "p2", "how", T[1]), ("3", "qa", "r", "cg", "d", "good", "keyword", "p", "other", T[2]),
            ("4", "qb", "r", "cx", "d", "bad", "vector", "p3", None, T[3]), ("5", "qb", "r", "cy", None, None, None, None, None, None),
        ],
        FEEDBACK,
    )


def test_feedback_reports(items):
    first, second = feedback.problem_queries(items).collect()
    assert (first.query_id, first.bad_ratio, first.question_text) == ("qb", 1.0, "")
    assert (second.bad_count, second.good_count, second.search_modes, second.question_text) == (2, 1, "vector,keyword,hybrid", "how")
    top = feedback.downvoted_chunks(items).first()
    assert (top.chunk_id, top.bad_count, top.distinct_query_count, top.source_path) == ("cb", 2, 1, "p2")
    assert [r.query_id for r in feedback.queries_without_good(items).collect()] == ["qb"]
    only = feedback.rechunk_candidates(items).collect()
    assert [(r.document_id, r.source_path, r.downvoted_chunk_count) for r in only] == [("d", "p3", 2)] and only[0].reason.startswith("2 distinct chunks")
    assert [r.id for r in feedback.select_feedback(items, "2025-01-02", "2025-01-04", "bad").collect()] == ["2", "4"]
    assert feedback.problem_queries(items.limit(0)).count() == 0


def test_recording(spark):
    evidence = spark.createDataFrame(
        [("r1", "q1", "text", "vector", 5, [(1, "c1", "d1", "p", 0.5)], T[0])],
        "retrieval_run_id string, query_id string, question_text string, search_mode string, top_k int, results array<struct<rank:int,chunk_id:string,document_id:string,source_path:string,score:double>>, created_at timestamp",
    )
    row = lambda *r: spark.createDataFrame([(*x, None, T[1]) for x in r], "id string, query_id string, retrieval_run_id string, chunk_id string, rating string, note string, created_at timestamp")
    stored = spark.createDataFrame([("old",)], "id string")
    good = ("f1", "q1", "r1", "c1", "good")
    item = feedback.record_feedback(row(good), evidence, stored).first()
    assert (item.document_id, item.rank, item.question_text) == ("d1", 1, "text")
    for bad in (("old", *good[1:]), ("f2", "qx", *good[2:]), ("f2", "q1", "rx", "c1", "good"), ("f2", "q1", "r1", "cx", "bad"), ("f2", "q1", "r1", "c1", "meh"), good):
        with pytest.raises(feedback.RejectedFeedback):
            feedback.record_feedback(row(good, bad), evidence, stored)


def test_latest_runs(spark):
    rows = spark.createDataFrame([("r1", "q", T[0]), ("r2", "q", T[1]), ("r3", "q", T[1]), ("r4", None, T[2])], "retrieval_run_id string, query_id string, created_at timestamp")
    assert [r.retrieval_run_id for r in feedback.latest_runs(rows, "query_id").collect()] == ["r3"]
