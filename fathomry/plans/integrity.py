"""Queries on stray references and on incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.operators import ledger
from fathomry.operators.orphans import Child, Parent, orphan_report, orphans
from fathomry.plans.registry import Registry
from fathomry.session import table

registry = Registry()


def stray_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "ingestion_docs")
    chunks = table(spark, sf_dir, "chunks")
    runs = table(spark, sf_dir, "retrieval_runs")
    feedback = table(spark, sf_dir, "feedback_items")
    answers = table(spark, sf_dir, "answers")
    parents = [
        Parent("ingestion_docs", docs.select("id", "updated_at", "status", "arrived_at"), "id", "arrived_at", "updated_at", F.col("status") == "Deleted"),
        Parent("chunks", chunks.select("chunk_id", "arrived_at"), "chunk_id", "arrived_at"),
        Parent("retrieval_runs", runs.select("retrieval_run_id", "arrived_at"), "retrieval_run_id", "arrived_at"),
    ]
    children = [
        Child("chunks", "document_id", "ingestion_docs", chunks, "chunk_id", F.col("document_id"), "arrived_at", alive=True),
        Child("feedback_items", "chunk_id", "chunks", feedback, "id", F.col("chunk_id"), "arrived_at"),
        Child("feedback_items", "retrieval_run_id", "retrieval_runs", feedback, "id", F.col("retrieval_run_id"), "arrived_at"),
        Child("answers", "citations.chunk_id", "chunks", answers, "id", F.col("citations.chunk_id"), "arrived_at"),
    ]
    return orphans(parents, children)


STRAY_SQL = """
WITH refs AS (
  SELECT 'chunks' AS ref_table, 'document_id' AS ref_field, 'd' AS parent, chunk_id AS record_id, document_id AS ref_key,
         min(arrived_at) OVER (PARTITION BY chunk_id, document_id) AS arrived FROM chunks
  UNION ALL SELECT 'feedback_items', 'chunk_id', 'c', id, chunk_id, min(arrived_at) OVER (PARTITION BY id, chunk_id) FROM feedback_items
  UNION ALL SELECT 'feedback_items', 'retrieval_run_id', 'r', id, retrieval_run_id, min(arrived_at) OVER (PARTITION BY id, retrieval_run_id) FROM feedback_items
  UNION ALL SELECT 'answers', 'citations.chunk_id', 'c', id, ref_key, arrived FROM (
    SELECT id, unnest(list_transform(citations, lambda x: x.chunk_id)) AS ref_key, min(arrived_at) OVER (PARTITION BY id) AS arrived FROM answers)
), uniq AS (SELECT ref_table, ref_field, parent, record_id, ref_key, min(arrived) AS arrived FROM refs WHERE ref_key IS NOT NULL GROUP BY ALL),
parents AS (
  SELECT 'd' AS parent, id AS ref_key, min(arrived_at) AS since, arg_max(status, updated_at) = 'Deleted' AS deleted FROM ingestion_docs GROUP BY id
  UNION ALL SELECT 'c', chunk_id, min(arrived_at), false FROM chunks GROUP BY chunk_id
  UNION ALL SELECT 'r', retrieval_run_id, min(arrived_at), false FROM retrieval_runs GROUP BY retrieval_run_id
), judged AS (
  SELECT u.*, CASE WHEN p.since IS NULL THEN 'missing' WHEN u.arrived < p.since THEN 'late' WHEN p.deleted THEN 'deleted' END AS reason
  FROM uniq u LEFT JOIN parents p ON u.parent = p.parent AND u.ref_key = p.ref_key
), stray AS (SELECT * FROM judged WHERE reason IS NOT NULL)
"""


@registry.query("p2_found", STRAY_SQL + "SELECT DISTINCT ref_table, ref_field, record_id, ref_key FROM stray")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The operator's rows are distinct already: one per field, record and key.
    return stray_references(spark, sf_dir).select("ref_table", "ref_field", "record_id", "ref_key")


@registry.query(
    "p2_report",
    STRAY_SQL
    + """SELECT ref_table, ref_field, strftime(arrived AT TIME ZONE 'UTC', '%Y-%m') AS month, reason, count(*) AS n_references,
         count(DISTINCT record_id) AS n_records FROM stray GROUP BY ALL""",
)
def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(stray_references(spark, sf_dir))


def ledger_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "ingest_runs")
    docs = table(spark, sf_dir, "ingestion_docs").select("id", "updated_at", "arrived_at", "content_hash", "status")
    return ledger.replay(docs, runs, "id", "updated_at", "arrived_at", "content_hash", F.col("status") == "Deleted")


STATES_SQL = """
WITH ok AS (SELECT run_id, started_at, row_number() OVER (ORDER BY started_at) AS n FROM ingest_runs WHERE run_status = 'succeeded'),
docs AS (SELECT DISTINCT id, updated_at, content_hash, status, min(arrived_at) AS arrived_at FROM ingestion_docs GROUP BY ALL),
state AS (
  SELECT ok.n, ok.run_id, docs.id, CASE WHEN arg_max(status, updated_at) <> 'Deleted' THEN arg_max(content_hash, updated_at) END AS h
  FROM ok JOIN docs ON docs.arrived_at <= ok.started_at GROUP BY ALL
), grid AS (SELECT ok.n, ok.run_id, i.id, s.h FROM ok CROSS JOIN (SELECT DISTINCT id FROM ingestion_docs) i LEFT JOIN state s ON s.n = ok.n AND s.id = i.id),
moved AS (SELECT *, lag(h) OVER (PARTITION BY id ORDER BY n) AS p FROM grid)
"""


@registry.query("p6_found", STATES_SQL + "SELECT run_id, id AS document_id FROM moved WHERE h IS DISTINCT FROM p")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = ledger_history(spark, sf_dir)
    return history.where(F.col("state") == "done").select("run_id", F.col("item").alias("document_id"))


# The same of every run: what it leased is what differs from the state at the last successful run before it.
LEDGER_SQL = """
WITH log AS (SELECT run_no, run_id, started_at, run_status, row_number() OVER (ORDER BY started_at, run_no, run_id) AS token FROM ingest_runs),
log2 AS (SELECT *, max(CASE WHEN run_status = 'succeeded' THEN token END) OVER (ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM log),
docs AS (SELECT id, updated_at, content_hash, status, min(arrived_at) AS arrived_at FROM ingestion_docs GROUP BY ALL),
state AS (SELECT token, id, CASE WHEN arg_max(status, updated_at) <> 'Deleted' THEN arg_max(content_hash, updated_at) END AS h
          FROM log JOIN docs ON docs.arrived_at <= log.started_at GROUP BY ALL)
SELECT i.id AS item, run_no, run_id, l.token, CASE WHEN run_status = 'succeeded' THEN 'done' WHEN run_status = 'running' AND l.token = (SELECT max(token) FROM log) THEN 'leased' ELSE 'expired' END AS state,
       s.h AS value, p.h AS previous_value, 'items/' || substr(sha256(i.id), 1, 2) || '/' || i.id || '/' || coalesce(substr(sha256(s.h), 1, 16), 'deleted') AS path
FROM log2 l CROSS JOIN (SELECT DISTINCT id FROM ingestion_docs) i LEFT JOIN state s ON s.token = l.token AND s.id = i.id LEFT JOIN state p ON p.token = l.base AND p.id = i.id
WHERE s.h IS DISTINCT FROM p.h
"""


@registry.query("p6_ledger", LEDGER_SQL)
def p6_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_history(spark, sf_dir)
