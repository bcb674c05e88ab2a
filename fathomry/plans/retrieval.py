"""Search queries: keyword, vector and hybrid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.functions.vectors import cosine, mock_embedding, norm, similarity
from fathomry.operators.keyword import keyword_candidates
from fathomry.operators.search import run_summary, search
from fathomry.operators.vector import vector_candidates
from fathomry.plans.registry import Registry
from fathomry.plans.tables import CHUNKS_SQL, DOCS_SQL, cosine_sql, current_chunks, current_documents, mock_sql, terms_sql
from fathomry.session import settle, spread, table

registry = Registry()
DIMENSION = 32
TOP = 8


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select(F.col("item_id").cast("string").alias("query_id"), "text")


def _bm25_sql(records: str, record: str, text: str) -> str:
    """CTEs up to ``scored (query_id, record, raw)``."""
    return f"""
base AS (SELECT {record} AS record, {terms_sql(text)} AS terms FROM {records}),
stats AS (SELECT count(*) AS n, avg(coalesce(len(terms), 0)) AS average FROM base),
post AS (SELECT record, len(terms) AS length, term, count(*) AS tf FROM (SELECT record, terms, unnest(terms) AS term FROM base) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
asked AS (SELECT DISTINCT item_id::VARCHAR AS query_id, term FROM (SELECT item_id, unnest({terms_sql('text')}) AS term FROM eval_items)),
scored AS (SELECT query_id, record, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) AS raw
           FROM asked JOIN post USING (term) JOIN freq USING (term) CROSS JOIN stats GROUP BY query_id, record)"""


@registry.query(
    "bm25_topk",
    "WITH " + _bm25_sql("documents", "doc_id", "text") + """
    SELECT query_id, record AS doc_id, round(raw, 6) AS raw_score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, record) AS rank FROM scored) WHERE rank <= 10""",
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keyword_candidates(questions(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "text", 10)
    return found.select("query_id", F.col("record").alias("doc_id"), F.round("raw_score", 6).alias("raw_score"), F.col("keyword_rank").alias("rank"))


_EMBED_SQL = """q AS (SELECT vec_id AS query_id, embedding AS e, label FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT q.query_id, q.label AS asked, v.vec_id, v.label, round(1 - list_cosine_similarity(q.e::DOUBLE[], v.embedding::DOUBLE[]), 9) AS distance FROM q CROSS JOIN embeddings v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id::VARCHAR) AS rank FROM d)"""


def _embedding_search(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    """The nearest embeddings of every embedding whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_candidates(asked, vectors, "vec_id", "embedding", depth)


@registry.query("cosine_topk", f"WITH {_EMBED_SQL} SELECT query_id::VARCHAR AS query_id, vec_id::VARCHAR AS vec_id, round(greatest(0, least(1, 1 - distance)), 6) AS score, rank FROM r WHERE rank <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _embedding_search(spark, sf_dir, 10)
    return found.select("query_id", F.col("record").alias("vec_id"), F.round(similarity(F.col("distance")), 6).alias("score"), F.col("vector_rank").alias("rank"))


@registry.query(
    "cosine_filtered_overfetch",
    f"""WITH {_EMBED_SQL}, kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM r WHERE rank <= 40 AND label = asked)
        SELECT query_id::VARCHAR AS query_id, vec_id::VARCHAR AS vec_id, rank, place FROM kept WHERE place <= 8""",
)
def cosine_filtered_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight results of the query's own label, out of forty candidates: fewer where the label is rare nearby."""
    from pyspark.sql import Window as W

    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("record"), "label")
    asked = labels.select(F.col("record").alias("query_id"), F.col("label").alias("asked"))
    kept = _embedding_search(spark, sf_dir, TOP * 5).join(labels, "record").join(asked, "query_id").where("label = asked")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("vector_rank"))
    return kept.withColumn("place", place).where(F.col("place") <= TOP).select("query_id", F.col("record").alias("vec_id"), F.col("vector_rank").alias("rank"), "place")


@registry.query(
    "vector_norms",
    "SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS mean_norm FROM embeddings GROUP BY label",
)
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(norm(F.col("embedding"))), 6).alias("mean_norm"))


@registry.query(
    "cosine_in_order",
    f"SELECT a.vec_id, round(CASE WHEN list_sum(list_transform(a.embedding, lambda x: abs(x))) * list_sum(list_transform(b.embedding, lambda x: abs(x))) > 0 THEN {cosine_sql('a.embedding', 'b.embedding')} ELSE 0 END, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def cosine_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine of each vector with the one of the next id."""
    rows = table(spark, sf_dir, "embeddings")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rows.join(following, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


def _search(spark: SparkSession, sf_dir: str, mode: str, explain: bool = False, **filters) -> DataFrame:
    # Read several times: for the statistics, the scores and what is shown of the results.
    chunks = settle(spread(current_chunks(spark, sf_dir)))
    asked = questions(spark, sf_dir).withColumn("vector", mock_embedding(F.col("text"), DIMENSION))
    for name, value in filters.items():
        asked = asked.withColumn(name, value)
    vectors = chunks.select("chunk_id", mock_embedding(F.col("content"), DIMENSION).alias("vector"))
    return search(asked, chunks, current_documents(spark, sf_dir), mode, TOP, vectors, explain=explain)


def _candidates_sql(vector_depth: int | None, keyword_depth: int | None) -> str:
    """CTEs up to ``found``: ranked candidates of each question joined with their documents."""
    parts = [f"WITH {DOCS_SQL}, {CHUNKS_SQL}"]
    if vector_depth:
        parts.append(f"""
qv AS (SELECT item_id::VARCHAR AS query_id, {mock_sql('text', DIMENSION)} AS e FROM eval_items),
cv AS (SELECT chunk_id, {mock_sql('content', DIMENSION)} AS e FROM cur),
vr AS (SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS vector_rank
       FROM (SELECT query_id, chunk_id, round(1 - list_cosine_similarity(qv.e, cv.e), 9) AS distance FROM qv CROSS JOIN cv)),
vc AS (SELECT query_id, chunk_id, vector_rank, greatest(0, least(1, 1 - distance)) AS vector_score, count(*) OVER (PARTITION BY query_id) AS n_vector FROM vr WHERE vector_rank <= {vector_depth})""")
    else:
        parts.append("vc AS (SELECT NULL::VARCHAR AS query_id, NULL::VARCHAR AS chunk_id, NULL::INT AS vector_rank, NULL::DOUBLE AS vector_score, NULL::INT AS n_vector WHERE false)")
    if keyword_depth:
        parts.append(_bm25_sql("cur", "chunk_id", "content") + f""",
kr AS (SELECT s.query_id, s.record AS chunk_id, s.raw, row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.raw, 9) DESC, c.source_path, s.record) AS keyword_rank FROM scored s JOIN cur c ON s.record = c.chunk_id),
kc AS (SELECT query_id, chunk_id, keyword_rank, raw / max(raw) OVER (PARTITION BY query_id) AS keyword_score, count(*) OVER (PARTITION BY query_id) AS n_keyword FROM kr WHERE keyword_rank <= {keyword_depth})""")
    else:
        parts.append("kc AS (SELECT NULL::VARCHAR AS query_id, NULL::VARCHAR AS chunk_id, NULL::INT AS keyword_rank, NULL::DOUBLE AS keyword_score, NULL::INT AS n_keyword WHERE false)")
    parts.append("""
m AS (SELECT coalesce(vc.query_id, kc.query_id) AS query_id, coalesce(vc.chunk_id, kc.chunk_id) AS chunk_id, vector_rank, vector_score, n_vector, keyword_rank, keyword_score, n_keyword
      FROM vc FULL JOIN kc ON vc.query_id = kc.query_id AND vc.chunk_id = kc.chunk_id),
found AS (SELECT m.*, c.source_path, c.document_id, d.project, d.tags FROM m JOIN cur c USING (chunk_id) JOIN docs d ON c.document_id = d.id WHERE d.status <> 'Deleted')""")
    return ", ".join(parts)


def _ranked_sql(score: str, where: str = "true") -> str:
    return f""", best AS (SELECT *, {score} AS score FROM found WHERE {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST, source_path, chunk_id) AS rank FROM best)"""


_RRF = "least(1, (coalesce(0.5 / (60 + vector_rank), 0) + coalesce(0.5 / (60 + keyword_rank), 0)) * 61)"


@registry.query("keyword_search", _candidates_sql(None, TOP) + _ranked_sql("keyword_score") + f"SELECT query_id, rank, chunk_id, document_id, round(score, 6) AS score FROM ranked WHERE rank <= {TOP}")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _search(spark, sf_dir, "keyword")
    return found.select("query_id", "rank", "chunk_id", "document_id", F.round("score", 6).alias("score"))


@registry.query(
    "keyword_search_filtered",
    _candidates_sql(None, TOP * 5) + _ranked_sql("keyword_score", "project = 'harbor-notes'") + f"SELECT query_id, rank, chunk_id, document_id, round(score, 6) AS score FROM ranked WHERE rank <= {TOP}",
)
def keyword_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _search(spark, sf_dir, "keyword", project=F.lit("harbor-notes"))
    return found.select("query_id", "rank", "chunk_id", "document_id", F.round("score", 6).alias("score"))


@registry.query(
    "keyword_search_source",
    _candidates_sql(None, TOP * 5) + _ranked_sql("keyword_score", "source_path = (SELECT cur.source_path FROM cur JOIN docs ON document_id = docs.id WHERE status <> 'Deleted' GROUP BY cur.source_path ORDER BY count(*) DESC, cur.source_path LIMIT 1)") + f"SELECT query_id, rank, chunk_id, document_id, round(score, 6) AS score FROM ranked WHERE rank <= {TOP}",
)
def keyword_search_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in one file: the one with the most chunks, of documents that are there."""
    there = current_documents(spark, sf_dir).where("status <> 'Deleted'").select(F.col("id").alias("document_id"))
    counted = current_chunks(spark, sf_dir).join(there, "document_id", "left_semi").groupBy("source_path").count()
    path = counted.agg(F.min(F.struct(-F.col("count"), "source_path"))["source_path"]).first()[0]
    found = _search(spark, sf_dir, "keyword", source=F.lit(path))
    return found.select("query_id", "rank", "chunk_id", "document_id", F.round("score", 6).alias("score"))


@registry.query("vector_search", _candidates_sql(TOP, None) + _ranked_sql("vector_score") + f"SELECT query_id, rank, chunk_id, document_id, round(score, 6) AS score FROM ranked WHERE rank <= {TOP}")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _search(spark, sf_dir, "vector")
    return found.select("query_id", "rank", "chunk_id", "document_id", F.round("score", 6).alias("score"))


@registry.query("hybrid_rrf", _candidates_sql(TOP * 5, TOP * 5) + _ranked_sql(_RRF) + f"SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= {TOP}")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "hybrid").select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@registry.query(
    "explain_hybrid",
    _candidates_sql(TOP * 5, TOP * 5) + _ranked_sql(_RRF, "list_has_all(tags, ['internal'])") + f"""
    SELECT query_id, rank, chunk_id, round(vector_score, 6) AS vector_score, round(keyword_score, 6) AS keyword_score,
      concat_ws('; ', CASE WHEN vector_rank IS NOT NULL THEN 'knn #' || vector_rank || ' of ' || n_vector || ' vector candidates' END,
        CASE WHEN keyword_rank IS NOT NULL THEN 'keyword #' || keyword_rank || ' of ' || n_keyword || ' candidates' END, 'passed active filter(s)') AS reason
    FROM ranked WHERE rank <= {TOP}""",
)
def explain_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _search(spark, sf_dir, "hybrid", explain=True, tags=F.array(F.lit("internal")))
    return found.select("query_id", "rank", "chunk_id", F.round("vector_score", 6).alias("vector_score"), F.round("keyword_score", 6).alias("keyword_score"), "reason")


@registry.query(
    "search_run_summary",
    _candidates_sql(TOP, None) + _ranked_sql("vector_score") + f"""
    SELECT item_id::VARCHAR AS query_id, count(rank) AS n_results, count(*) FILTER (score < 0.3) AS below_threshold
    FROM eval_items LEFT JOIN (SELECT * FROM ranked WHERE rank <= {TOP}) r ON item_id::VARCHAR = r.query_id GROUP BY item_id""",
)
def search_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_summary(questions(spark, sf_dir), _search(spark, sf_dir, "vector"), "vector")


# The six vectors of the smallest self-check, and its query.
TOY = [("doc-arch-1", [1.0, 0.0, 0.0, 0.0]), ("doc-arch-2", [0.9, 0.1, 0.0, 0.0]), ("doc-deploy-1", [0.0, 1.0, 0.0, 0.0]), ("doc-deploy-2", [0.1, 0.9, 0.0, 0.0]), ("doc-rag-1", [0.0, 0.0, 1.0, 0.0]), ("doc-rag-2", [0.0, 0.0, 0.9, 0.1])]
TOY_QUERY = [0.95, 0.05, 0.0, 0.0]


@registry.query(
    "toy_knn",
    f"SELECT id, round(1 - {cosine_sql('v', str(TOY_QUERY))}, 6) AS distance FROM (VALUES " + ", ".join(f"('{n}', {v})" for n, v in TOY) + ") t(id, v) ORDER BY distance, id LIMIT 3",
)
def toy_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(TOY, "id string, vector array<double>")
    asked = spark.createDataFrame([("q", TOY_QUERY)], "query_id string, vector array<double>")
    return vector_candidates(asked, rows, "id", "vector", 3).select(F.col("record").alias("id"), F.round("distance", 6).alias("distance"))
