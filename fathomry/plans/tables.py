"""Current rows of the domain tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.session import table

DOC_COLUMNS = ["id", "source_path", "file_name", "file_extension", "content_hash", "title", "project", "tags", "status", "embedding_model", "embedding_dimension"]
CHUNK_COLUMNS = ["chunk_id", "document_id", "source_path", "chunk_index", "heading_path", "content", "preview", "token_count", "config_name"]
FEEDBACK_COLUMNS = ["id", "query_id", "retrieval_run_id", "chunk_id", "document_id", "rating", "search_mode", "rank", "score", "source_path", "question_text", "created_at"]
RUN_COLUMNS = ["retrieval_run_id", "query_id", "question_text", "search_mode", "top_k", "results", "created_at"]


def _first(rows: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    kept = rows.where(F.col(key).isNotNull())
    return kept.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*columns), order).alias("row")).select("row.*")


def current_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of every document."""
    rows = table(spark, sf_dir, "ingestion_docs").where(F.col("id").isNotNull())
    return rows.groupBy(F.col("id").alias("__key")).agg(F.max_by(F.struct(*DOC_COLUMNS), "updated_at").alias("row")).select("row.*")


def current_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(table(spark, sf_dir, "chunks"), "chunk_id", CHUNK_COLUMNS, "arrived_at")


def current_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(table(spark, sf_dir, "feedback_items"), "id", FEEDBACK_COLUMNS, "arrived_at")


def current_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(table(spark, sf_dir, "retrieval_runs"), "retrieval_run_id", RUN_COLUMNS, "arrived_at")


def _sql(name: str, source: str, key: str, order: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn_ FROM {source} WHERE {key} IS NOT NULL) WHERE rn_ = 1)"


DOCS_SQL = _sql("docs", "ingestion_docs", "id", "updated_at DESC, arrived_at")
CHUNKS_SQL = _sql("cur", "chunks", "chunk_id", "arrived_at")
FEEDBACK_SQL = _sql("fb", "feedback_items", "id", "arrived_at")
RUNS_SQL = _sql("runs", "retrieval_runs", "retrieval_run_id", "arrived_at")

# SQL for the text functions: DuckDB's \S knows ASCII blanks only.
BLANKS_SQL = "[^\\t-\\r\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def words_sql(column: str) -> str:
    return f"regexp_extract_all({column}, '{BLANKS_SQL}')"


def terms_sql(column: str) -> str:
    return f"regexp_extract_all(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"


def preview_sql(column: str) -> str:
    flat = f"array_to_string({words_sql(column)}, ' ')"
    return f"CASE WHEN length({flat}) > 120 THEN substr({flat}, 1, 120) || '…' ELSE {flat} END"


def mock_sql(column: str, dimension: int) -> str:
    digit = lambda at: f"(instr('0123456789abcdef', substr(sha256({column}), {at}, 1)) - 1)"
    return f"list_transform(range(0, {dimension}), lambda i: ({digit('2 * (i % 32) + 1')} * 16 + {digit('2 * (i % 32) + 2')}) / 255.0::DOUBLE)"


def cosine_sql(a: str, b: str) -> str:
    total = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
    return f"({total(a, b)} / (sqrt({total(a, a)}) * sqrt({total(b, b)})))"
