"""Queries on retrieval quality, answers and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.operators import answer, evaluate, feedback
from fathomry.plans.registry import Registry
from fathomry.plans.tables import FEEDBACK_SQL, RUNS_SQL, current_feedback, current_runs, words_sql
from fathomry.session import table
from fathomry.streaming.ingest import feedback_counts

registry = Registry()
BUDGET = 60

_LATEST_SQL = f"""WITH {RUNS_SQL}, latest AS (SELECT * FROM (SELECT * EXCLUDE (rn_), row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, retrieval_run_id DESC) AS k FROM runs WHERE query_id IS NOT NULL) WHERE k = 1),
res AS (SELECT query_id, search_mode, r.rank AS rank, r.chunk_id AS chunk_id, r.document_id AS document_id, r.source_path AS source_path, r.score::DOUBLE AS score, r.preview AS preview, r.heading_path AS heading_path
        FROM (SELECT query_id, search_mode, unnest(results) AS r FROM latest))"""


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.latest_runs(current_runs(spark, sf_dir), "query_id")


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of each query's latest run, one row each."""
    r = latest(spark, sf_dir).select("query_id", "search_mode", F.explode("results").alias("r"))
    return r.select("query_id", "search_mode", "r.rank", "r.chunk_id", "r.document_id", "r.source_path", F.col("r.score").cast("double").alias("score"), "r.preview", "r.heading_path")


@registry.query("latest_run_per_query", _LATEST_SQL + "SELECT query_id, retrieval_run_id, search_mode, len(results) AS n_results FROM latest")
def latest_run_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).select("query_id", "retrieval_run_id", "search_mode", F.size("results").alias("n_results"))


# Chunks rated good are the ground truth of their query.
_JUDGED_SQL = _LATEST_SQL + f""", {FEEDBACK_SQL}, truth AS (SELECT query_id, list(DISTINCT chunk_id) AS good FROM fb WHERE rating = 'good' AND query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY query_id),
judged AS (SELECT t.query_id AS question_id, min(rank) FILTER (list_contains(good, r.chunk_id)) AS first_rank, arg_min(score, rank) AS top_score, count(rank) AS n,
           array_to_string(list(r.chunk_id ORDER BY rank) FILTER (rank IS NOT NULL), ' ') AS returned FROM truth t LEFT JOIN res r USING (query_id) GROUP BY t.query_id)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = current_feedback(spark, sf_dir).where("rating = 'good' and query_id is not null and chunk_id is not null")
    truth = good.groupBy(F.col("query_id").alias("question_id")).agg(F.collect_set("chunk_id").alias("expected_chunk_ids"))
    questions = evaluate.has_ground_truth(truth.withColumn("expected_source_files", F.array().cast("array<string>")))
    return evaluate.judge(questions, shown(spark, sf_dir))


@registry.query(
    "eval_judgements",
    _JUDGED_SQL + """SELECT question_id, first_rank, coalesce(first_rank <= 1, false) AS hit_at_1, coalesce(first_rank <= 3, false) AS hit_at_3, coalesce(first_rank <= 5, false) AS hit_at_5,
    round(coalesce(1.0 / first_rank, 0), 6) AS reciprocal_rank, round(top_score, 5) AS top_score, n = 0 AS empty, coalesce(returned, '') AS returned FROM judged""",
)
def eval_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select(
        "question_id", "first_rank", "hit_at_1", "hit_at_3", "hit_at_5", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.round("top_score", 5).alias("top_score"), "empty",
        F.array_join("returned_chunk_ids", " ").alias("returned"),
    )


_METRICS_SQL = """count(*) AS question_count, round(coalesce(avg(coalesce(first_rank <= 1, false)::INT), 0), 6) AS hit_at_1, round(coalesce(avg(coalesce(first_rank <= 3, false)::INT), 0), 6) AS hit_at_3,
round(coalesce(avg(coalesce(first_rank <= 5, false)::INT), 0), 6) AS hit_at_5, round(coalesce(avg(coalesce(1.0 / first_rank, 0)), 0), 6) AS mrr, count(*) FILTER (n = 0) AS empty_count,
count(*) FILTER (n = 0 OR top_score < 0.3) AS below_threshold_count"""


def rounded_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = evaluate.metrics(judged(spark, sf_dir), "vector")
    return measured.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in measured.dtypes])


@registry.query("eval_metrics", _JUDGED_SQL + f"SELECT {_METRICS_SQL} FROM judged")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_metrics(spark, sf_dir)


@registry.query("eval_gate", _JUDGED_SQL + f"SELECT hit_at_3, CASE WHEN hit_at_3 < 0.6 THEN 'failed_threshold' ELSE 'completed' END AS status FROM (SELECT {_METRICS_SQL} FROM judged)")
def eval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gate(rounded_metrics(spark, sf_dir), 0.6).select("hit_at_3", "status")


_CONTEXT_SQL = _LATEST_SQL + f""", strong AS (SELECT *, coalesce(len({words_sql('preview')}), 0) AS tokens FROM res WHERE score >= 0.3),
budgeted AS (SELECT *, sum(tokens) OVER w AS running_tokens, row_number() OVER w AS place FROM strong WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)),
ctx AS (SELECT * FROM budgeted WHERE running_tokens <= {BUDGET} OR place = 1)"""


def budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.context(shown(spark, sf_dir), "vector", BUDGET)


@registry.query("context_budget", _CONTEXT_SQL + "SELECT query_id, rank, chunk_id, tokens, running_tokens FROM ctx")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budgeted(spark, sf_dir).select("query_id", "rank", "chunk_id", "tokens", "running_tokens")


_ASKED_SQL = "asked AS (SELECT query_id, coalesce(question_text, '') AS text FROM latest)"
_PROMPT_SQL = _CONTEXT_SQL + f""", {_ASKED_SQL},
blocks AS (SELECT query_id, array_to_string(list('[[chunk:' || chunk_id || ']] (source=' || source_path || ')' || CASE WHEN len(heading_path) > 0 THEN ' [' || array_to_string(heading_path, ' > ') || ']' ELSE '' END
           || chr(10) || preview ORDER BY rank), chr(10) || chr(10)) AS b FROM ctx WHERE preview IS NOT NULL AND source_path IS NOT NULL GROUP BY query_id),
prompt AS (SELECT query_id, replace(replace('Sources:' || chr(10) || '{{{{chunks}}}}' || chr(10) || chr(10) || 'Question: {{{{question}}}}', '{{{{chunks}}}}', b), '{{{{question}}}}', text)
           || chr(10) || chr(10) || '{answer.INSTRUCTIONS}' AS message FROM blocks JOIN asked USING (query_id))"""


def questions_of_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).select("query_id", F.coalesce("question_text", F.lit("")).alias("text"))


def prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = budgeted(spark, sf_dir).where("preview is not null and source_path is not null")
    return answer.prompts(questions_of_latest(spark, sf_dir), whole)


@registry.query("render_prompt", _PROMPT_SQL + "SELECT query_id, message FROM prompt")
def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompted(spark, sf_dir)


_REPLY_SQL = _PROMPT_SQL + """, tagged AS (SELECT query_id, list_filter(regexp_extract_all(message, '(?s)\\[\\[chunk:(.*?)\\]\\]', 1), lambda x: x <> '') AS ids FROM prompt),
uniq AS (SELECT query_id, list_filter(ids, lambda x, i: list_position(ids, x) = i)[1:3] AS cited FROM tagged)"""


@registry.query("prompt_citations", _REPLY_SQL + "SELECT query_id, array_to_string(cited, ' ') AS cited FROM uniq")
def prompt_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.offline_replies(prompted(spark, sf_dir)).select("query_id", F.array_join("cited", " ").alias("cited"))


@registry.query(
    "answers",
    _REPLY_SQL + """, r2 AS (SELECT query_id, array_to_string(list(res.chunk_id ORDER BY rank) FILTER (list_contains(cited, res.chunk_id)), ' ') AS citations,
      count(*) FILTER (NOT coalesce(list_contains(cited, res.chunk_id), false)) AS n_unused, any_value(len(cited)) AS n FROM res LEFT JOIN uniq USING (query_id) GROUP BY query_id)
    SELECT query_id, CASE WHEN n > 0 THEN 'Based on the retrieved documentation, here is an answer grounded in ' || n || ' source(s). See the cited sources for details.' END AS answer_text,
      coalesce(citations, '') AS citations, coalesce(n_unused, 0) AS n_unused, CASE WHEN n IS NULL THEN 'belowSimilarityThreshold' END AS no_answer_reason FROM latest LEFT JOIN r2 USING (query_id)""",
)
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answer.answers(questions_of_latest(spark, sf_dir), shown(spark, sf_dir), answer.offline_replies(prompted(spark, sf_dir)))
    cited = F.array_join(F.transform("citations", lambda c: c["chunk_id"]), " ")
    return found.select("query_id", "answer_text", cited.alias("citations"), F.size("retrieved_but_unused_chunks").alias("n_unused"), "no_answer_reason")


@registry.query("answer_invariant", "SELECT DISTINCT id FROM answers WHERE no_answer_reason IS NULL AND coalesce(len(citations), 0) = 0")
def answer_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.broken_answers(table(spark, sf_dir, "answers")).select("id").distinct()


@registry.query(
    "citations_outside_run",
    f"""WITH {RUNS_SQL}, cited AS (SELECT DISTINCT id, retrieval_run_id, c.chunk_id AS chunk_id FROM (SELECT id, retrieval_run_id, unnest(citations) AS c FROM answers) WHERE c.chunk_id IS NOT NULL)
        SELECT id, cited.retrieval_run_id, chunk_id FROM cited JOIN runs USING (retrieval_run_id) WHERE NOT coalesce(list_contains(list_transform(results, lambda r: r.chunk_id), chunk_id), false)""",
)
def citations_outside_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded citations that their run never retrieved."""
    cited = table(spark, sf_dir, "answers").select("id", "retrieval_run_id", F.explode("citations.chunk_id").alias("chunk_id")).where("chunk_id is not null").distinct()
    runs = current_runs(spark, sf_dir).select("retrieval_run_id", F.col("results.chunk_id").alias("retrieved"))
    inside = F.coalesce(F.array_contains("retrieved", F.col("chunk_id")), F.lit(False))
    return cited.join(runs, "retrieval_run_id").where(~inside).select("id", "retrieval_run_id", "chunk_id")


_RATED_SQL = f"WITH {FEEDBACK_SQL}"
_BY_QUERY_SQL = _RATED_SQL + """, bq AS (SELECT query_id, coalesce(arg_min(question_text, (created_at, id)) FILTER (length(question_text) > 0), '') AS question_text,
  concat_ws(',', CASE WHEN bool_or(search_mode = 'vector') THEN 'vector' END, CASE WHEN bool_or(search_mode = 'keyword') THEN 'keyword' END, CASE WHEN bool_or(search_mode = 'hybrid') THEN 'hybrid' END) AS search_modes,
  count(*) FILTER (rating = 'bad') AS bad_count, count(*) FILTER (rating = 'good') AS good_count FROM fb GROUP BY query_id)"""


@registry.query("feedback_problem_queries", _BY_QUERY_SQL + "SELECT query_id, question_text, search_modes, bad_count, good_count, round(bad_count / (bad_count + good_count), 6) AS bad_ratio FROM bq WHERE bad_count > 0")
def feedback_problem_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.problem_queries(current_feedback(spark, sf_dir)).withColumn("bad_ratio", F.round("bad_ratio", 6))


@registry.query(
    "feedback_downvoted",
    _RATED_SQL + """SELECT chunk_id, arg_max(coalesce(document_id, ''), (created_at, id)) AS document_id, arg_max(coalesce(source_path, ''), (created_at, id)) AS source_path, count(*) AS bad_count,
    count(DISTINCT query_id) AS distinct_query_count FROM fb WHERE rating = 'bad' GROUP BY chunk_id""",
)
def feedback_downvoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.downvoted_chunks(current_feedback(spark, sf_dir))


@registry.query("feedback_no_good", _BY_QUERY_SQL + "SELECT query_id, question_text, bad_count AS total_feedback, good_count FROM bq WHERE good_count = 0 AND bad_count > 0")
def feedback_no_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.queries_without_good(current_feedback(spark, sf_dir))


@registry.query(
    "feedback_rechunk",
    _RATED_SQL + """SELECT document_id, arg_max(coalesce(source_path, ''), (created_at, id)) AS source_path, count(DISTINCT chunk_id) AS downvoted_chunk_count,
    count(DISTINCT chunk_id) || ' distinct chunks in this document received bad feedback' AS reason FROM fb WHERE rating = 'bad' AND document_id IS NOT NULL GROUP BY document_id HAVING count(DISTINCT chunk_id) >= 2""",
)
def feedback_rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.rechunk_candidates(current_feedback(spark, sf_dir))


@registry.query(
    "feedback_selected",
    _RATED_SQL + "SELECT id, query_id, rating FROM fb WHERE rating = 'bad' AND created_at >= TIMESTAMPTZ '2025-04-01 00:00:00+00' AND created_at <= TIMESTAMPTZ '2025-06-30 23:59:59+00'",
)
def feedback_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.select_feedback(current_feedback(spark, sf_dir), "2025-04-01 00:00:00", "2025-06-30 23:59:59", "bad").select("id", "query_id", "rating")


_STORED_UNTIL = "2025-06-01"


@registry.query(
    "feedback_validation",
    f"""WITH {FEEDBACK_SQL}, {RUNS_SQL}
        SELECT CASE WHEN NOT coalesce(rating IN ('good', 'bad'), false) THEN 'unknown rating' WHEN r.query_id IS NULL THEN 'retrieval run was not found'
          WHEN r.query_id IS DISTINCT FROM fb.query_id THEN 'query id does not match the run'
          WHEN NOT coalesce(list_contains(list_transform(results, lambda x: x.chunk_id), fb.chunk_id), false) THEN 'chunk was not displayed in the run' ELSE 'accepted' END AS verdict, count(*) AS n
        FROM fb LEFT JOIN runs r ON fb.retrieval_run_id = r.retrieval_run_id GROUP BY verdict""",
)
def feedback_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recording the stored feedback against the run evidence would say."""
    inputs = current_feedback(spark, sf_dir).select("id", "query_id", "retrieval_run_id", "chunk_id", "rating", F.lit(None).cast("string").alias("note"), "created_at")
    verdicts = feedback.judged_inputs(inputs, current_runs(spark, sf_dir), inputs.limit(0).select("id"))
    return verdicts.groupBy(F.coalesce("problem", F.lit("accepted")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@registry.query(
    "feedback_conflicts",
    f"""WITH {FEEDBACK_SQL}, {RUNS_SQL}, twice AS (SELECT id, count(*) AS times FROM feedback_items WHERE id IS NOT NULL GROUP BY id), stored AS (SELECT id FROM fb WHERE created_at < TIMESTAMPTZ '{_STORED_UNTIL} 00:00:00+00')
        SELECT f.id, CASE WHEN times > 1 THEN 'feedback id appears more than once in this batch' WHEN s.id IS NOT NULL THEN 'feedback id already exists'
          WHEN NOT coalesce(rating IN ('good', 'bad'), false) THEN 'unknown rating' WHEN r.query_id IS NULL THEN 'retrieval run was not found'
          WHEN r.query_id IS DISTINCT FROM f.query_id THEN 'query id does not match the run'
          WHEN NOT coalesce(list_contains(list_transform(results, lambda x: x.chunk_id), f.chunk_id), false) THEN 'chunk was not displayed in the run' END AS problem
        FROM feedback_items f JOIN twice ON f.id = twice.id LEFT JOIN stored s ON f.id = s.id LEFT JOIN runs r ON f.retrieval_run_id = r.retrieval_run_id""",
)
def feedback_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recording all deliveries of feedback as one batch would say of each, if the earlier items were stored already."""
    rows = table(spark, sf_dir, "feedback_items").where(F.col("id").isNotNull())
    inputs = rows.select("id", "query_id", "retrieval_run_id", "chunk_id", "rating", "note", "created_at")
    stored = current_feedback(spark, sf_dir).where(F.col("created_at") < F.lit(f"{_STORED_UNTIL} 00:00:00").cast("timestamp")).select("id")
    return feedback.judged_inputs(inputs, current_runs(spark, sf_dir), stored).select("id", "problem")


@registry.query(
    "feedback_windows",
    _RATED_SQL + """SELECT strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:00:00') AS window_start, search_mode, count(*) FILTER (rating = 'good') AS good_count, count(*) FILTER (rating = 'bad') AS bad_count
    FROM fb WHERE created_at IS NOT NULL GROUP BY ALL""",
)
def feedback_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = feedback_counts(current_feedback(spark, sf_dir))
    return counted.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
