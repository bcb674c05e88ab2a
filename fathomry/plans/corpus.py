"""Queries on texts, identifiers, chunks and the state of ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.functions import ids, text
from fathomry.functions.paths import extension, normal_path, path_matches
from fathomry.functions.vectors import mock_embedding
from fathomry.operators.chunking import ChunkingConfig, chunk_documents
from fathomry.operators.filters import passes
from fathomry.operators.ingest import chunk_metadata, file_outcomes, missing_documents
from fathomry.operators.keyword import corpus_stats, term_stats
from fathomry.plans.registry import Registry
from fathomry.plans.tables import CHUNKS_SQL, DOCS_SQL, current_chunks, current_documents, mock_sql, preview_sql, terms_sql, words_sql
from fathomry.session import spread, table
from fathomry.sources.files import parser_of, skip_reason

registry = Registry()


@registry.query(
    "tokenize_documents",
    f"SELECT doc_id, len({terms_sql('text')}) AS n_terms, len(list_distinct({terms_sql('text')})) AS n_distinct, sha256(array_to_string({terms_sql('text')}, ' ')) AS digest FROM documents",
)
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("t", text.terms(F.col("text")))
    return rows.select("doc_id", F.size("t").alias("n_terms"), F.size(F.array_distinct("t")).alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@registry.query(
    "word_counts_preview",
    f"""SELECT doc_id, len({words_sql('text')}) AS n_words, {preview_sql('text')} AS preview, length(text) AS char_length,
        array_to_string(list_slice({words_sql('text')}, greatest(len({words_sql('text')}) - 7, 1), len({words_sql('text')})), ' ') AS tail FROM documents""",
)
def word_counts_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.word_count(t).alias("n_words"), text.preview(t).alias("preview"), F.length(t).alias("char_length"), text.last_words(t, 8).alias("tail")
    )


_ID_SQL = "'doc_' || substr(sha256(source_path), 1, 16)"


@registry.query(
    "document_ids",
    f"""SELECT chunk_id AS recorded_id, {_ID_SQL} AS document_id, sha256(content) AS content_hash,
        'chunk_' || substr(sha256({_ID_SQL} || ':' || chunk_index::VARCHAR || ':' || sha256(content)), 1, 16) AS chunk_id
        FROM (SELECT DISTINCT chunk_id, source_path, chunk_index, content FROM chunks)""",
)
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunks").select("chunk_id", "source_path", "chunk_index", "content").distinct()
    document, digest = ids.document_id(F.col("source_path")), ids.content_hash(F.col("content"))
    return rows.select(F.col("chunk_id").alias("recorded_id"), document.alias("document_id"), digest.alias("content_hash"), ids.chunk_id(document, F.col("chunk_index"), digest).alias("chunk_id"))


@registry.query(
    "markdown_titles",
    "SELECT doc_id, trim(regexp_extract(text, '(?m)^[^\\S\\n]*# (.*)$', 1)) AS heading FROM documents WHERE regexp_matches(text, '(?m)^[^\\S\\n]*# .*$')",
)
def markdown_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.markdown_title(F.col("text")).alias("heading")).where(F.col("heading").isNotNull())


@registry.query(
    "term_stats",
    f"""WITH t AS (SELECT doc_id, {terms_sql('text')} AS terms FROM documents),
        s AS (SELECT count(*) AS n, avg(coalesce(len(terms), 0)) AS average FROM t)
        SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences, any_value(n) AS n_documents, round(any_value(average), 6) AS average_length
        FROM (SELECT doc_id, unnest(terms) AS term FROM t) CROSS JOIN s GROUP BY term""",
)
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stats = corpus_stats(docs, "doc_id", "text")
    return term_stats(docs, "doc_id", "text").select("term", "df", "occurrences", stats.select("n").scalar().alias("n_documents"), F.round(stats.select("average").scalar(), 6).alias("average_length"))


@registry.query("mock_embed", f"SELECT doc_id, i AS place, round(v[i], 6) AS value FROM (SELECT doc_id, {mock_sql('text', 48)} AS v FROM documents), unnest(range(1, 49)) AS u(i)")
def mock_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(mock_embedding(F.col("text"), 48)).alias("place", "value"))
    # A null text has 48 places without values, as in the SQL.
    placed = rows.select("doc_id", F.explode(F.when(F.col("place").isNull(), F.sequence(F.lit(1), F.lit(48))).otherwise(F.array(F.col("place") + 1))).alias("place"), "value")
    return placed.withColumn("value", F.round("value", 6))


@registry.query(
    "chunk_metadata",
    f"""WITH {CHUNKS_SQL}, {DOCS_SQL} SELECT chunk_id, 'char_length=' || length(content) || ' embedding_dimension=32 embedding_model=mock source_path=' || cur.source_path || coalesce(' title=' || title, '') AS metadata
        FROM cur JOIN docs ON cur.document_id = docs.id WHERE cur.source_path IS NOT NULL AND content IS NOT NULL""",
)
def chunk_metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata an ingestion would give each chunk, as text in order of its keys."""
    docs = current_documents(spark, sf_dir).select(F.col("id").alias("document_id"), "title")
    rows = current_chunks(spark, sf_dir).join(docs, "document_id").where(F.col("source_path").isNotNull() & F.col("content").isNotNull())
    entries = F.transform(F.array_sort(F.map_entries(chunk_metadata("mock", 32))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("chunk_id", F.array_join(entries, " ").alias("metadata"))


@registry.query(
    "parser_dispatch",
    """WITH x AS (SELECT id, source_path, lower(regexp_extract(string_split(replace(source_path, '\\', '/'), '/')[-1], '[^.]\\.([^.]*)$', 1)) AS extension FROM (SELECT DISTINCT id, source_path FROM ingestion_docs))
       SELECT id, extension, CASE WHEN extension = 'md' THEN 'markdown' WHEN extension IN ('txt', 'json', 'yaml', 'yml') THEN 'text' END AS parser,
       CASE WHEN extension NOT IN ('md', 'txt', 'json', 'yaml', 'yml') THEN 'unsupported extension ''.' || extension || '''' END AS skipped FROM x""",
)
def parser_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ingestion_docs").select("id", "source_path").distinct().withColumn("extension", extension(F.col("source_path")))
    return rows.select("id", "extension", parser_of(F.col("extension")).alias("parser"), skip_reason(F.col("extension")).alias("skipped"))


def _chunked(spark: SparkSession, sf_dir: str, kind: str, config: ChunkingConfig) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(ids.document_id(F.col("doc_id").cast("string")).alias("document_id"), F.lit(kind).alias("extension"), "text")
    return chunk_documents(spread(rows), config).withColumn("heading_path", F.array_join("heading_path", " > "))


_SIZES = ChunkingConfig(60, 100, 12)
_SPACES = "[\\t-\\r\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _strip_sql(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '^{_SPACES}+', ''), '{_SPACES}+$', '')"


def _tail_sql(column: str) -> str:
    return f"array_to_string(list_slice({words_sql(column)}, greatest(len({words_sql(column)}) - {_SIZES.overlap - 1}, 1), len({words_sql(column)})), ' ')"


# Paragraphs one by one: what is held before and after each, and what is emitted before it is added (a), once it is (b) and in the end (c).
CHUNK_PLAIN_SQL = f"""
WITH RECURSIVE units AS (
  SELECT 'doc_' || substr(sha256(doc_id::VARCHAR), 1, 16) AS document_id,
         list_filter(list_transform(regexp_split_to_array(replace(text, chr(13) || chr(10), chr(10)), '\n{_SPACES}*\n'), lambda u: {_strip_sql('u')}), lambda u: u <> '') AS u
  FROM documents WHERE text IS NOT NULL
), steps AS (
  SELECT document_id, u, 0 AS i, '' AS held, 0 AS size, NULL::VARCHAR AS a, NULL::VARCHAR AS b FROM units WHERE len(u) > 0
  UNION ALL
  SELECT document_id, u, i, CASE WHEN size >= {_SIZES.target} THEN {_tail_sql('held')} ELSE held END AS held,
         CASE WHEN size >= {_SIZES.target} THEN least({_SIZES.overlap}, len({words_sql('held')})) ELSE size END AS size, a, CASE WHEN size >= {_SIZES.target} THEN held END AS b
  FROM (SELECT document_id, u, i, CASE WHEN held = '' THEN u[i] ELSE held || chr(10) || chr(10) || u[i] END AS held, size + len({words_sql('u[i]')}) AS size, a
        FROM (SELECT document_id, u, i, CASE WHEN over THEN {_tail_sql('held')} ELSE held END AS held, CASE WHEN over THEN least({_SIZES.overlap}, len({words_sql('held')})) ELSE size END AS size,
                     CASE WHEN over THEN held END AS a
              FROM (SELECT document_id, u, i + 1 AS i, held, size, held <> '' AND size + len({words_sql('u[i + 1]')}) > {_SIZES.most} AS over FROM steps WHERE i < len(u))))
), pieces AS (
  SELECT document_id, i, 1 AS k, {_strip_sql('a')} AS content FROM steps WHERE a IS NOT NULL
  UNION ALL SELECT document_id, i, 2, {_strip_sql('b')} FROM steps WHERE b IS NOT NULL
  UNION ALL SELECT document_id, i, 3, {_strip_sql('held')} FROM steps WHERE i = len(u) AND held <> ''
), numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY i, k) - 1 AS chunk_index, sha256(content) AS content_hash FROM pieces)
SELECT 'chunk_' || substr(sha256(document_id || ':' || chunk_index::VARCHAR || ':' || content_hash), 1, 16) AS chunk_id, document_id, chunk_index, '' AS heading_path, content,
       {preview_sql('content')} AS preview, content_hash, len({words_sql('content')}) AS token_count FROM numbered
"""


@registry.query("chunk_plain", CHUNK_PLAIN_SQL)
def chunk_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir, "txt", _SIZES)


# Lines with their fences and headings, then units by section, then packing as above, where code over the limit stands alone.
CHUNK_MARKDOWN_SQL = f"""
WITH RECURSIVE lines AS (
  SELECT document_id, i, l, regexp_replace(l, '^{_SPACES}+', '') AS bare FROM (
    SELECT document_id, i, regexp_replace(parts[i], '\\r$', '') AS l FROM (
      SELECT 'doc_' || substr(sha256(doc_id::VARCHAR), 1, 16) AS document_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), unnest(range(1, len(parts) + 1)) AS r(i))
), fenced AS (
  SELECT *, starts_with(bare, '```') OR starts_with(bare, '~~~') AS fence, sum(CASE WHEN starts_with(bare, '```') OR starts_with(bare, '~~~') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY i) AS f FROM lines
), kinds AS (
  SELECT *, fence OR f % 2 = 1 AS code, CASE WHEN NOT fence AND f % 2 = 0 THEN len(regexp_extract(bare, '^#+')) ELSE 0 END AS signs FROM fenced
), marked AS (
  SELECT *, CASE WHEN signs BETWEEN 1 AND 6 THEN signs END AS level, NOT code AND bare = '' AS blank FROM kinds
), parted AS (
  SELECT *, count(level) OVER w AS section, sum(CASE WHEN blank OR level IS NOT NULL OR fence THEN 1 ELSE 0 END) OVER w AS part FROM marked WINDOW w AS (PARTITION BY document_id ORDER BY i)
), raw_units AS (
  SELECT document_id, section, min(i) AS i, code, string_agg(l, chr(10) ORDER BY i) AS body
  FROM (SELECT *, CASE WHEN code THEN -((f + 1) // 2) ELSE part END AS run FROM parted WHERE NOT blank AND level IS NULL) GROUP BY document_id, section, code, run
), units AS (
  SELECT document_id, section, i, code, CASE WHEN code THEN regexp_replace(body, '{_SPACES}+$', '') ELSE {_strip_sql('body')} END AS body FROM raw_units
), heads AS (SELECT document_id, section, level, {_strip_sql("bare[level + 1 :]")} AS title FROM parted WHERE level IS NOT NULL),
paths AS (
  SELECT a.document_id, a.section, string_agg(b.title, ' > ' ORDER BY b.section) AS heading_path
  FROM heads a JOIN heads b ON a.document_id = b.document_id AND (b.section = a.section OR b.section < a.section AND b.level < a.level
    AND NOT EXISTS (SELECT 1 FROM heads c WHERE c.document_id = a.document_id AND c.section > b.section AND c.section < a.section AND c.level <= b.level))
  GROUP BY ALL
), lists AS (SELECT document_id, section, list(struct_pack(code := code, body := body) ORDER BY i) AS u FROM units WHERE body <> '' GROUP BY document_id, section),
steps AS (
  SELECT document_id, section, u, 0 AS i, '' AS held, 0 AS size, NULL::VARCHAR AS a, NULL::VARCHAR AS b FROM lists
  UNION ALL
  SELECT document_id, section, u, i, CASE WHEN alone THEN '' WHEN size >= {_SIZES.target} THEN {_tail_sql('held')} ELSE held END AS held,
         CASE WHEN alone THEN 0 WHEN size >= {_SIZES.target} THEN least({_SIZES.overlap}, len({words_sql('held')})) ELSE size END AS size, a, CASE WHEN alone THEN u[i].body WHEN size >= {_SIZES.target} THEN held END AS b
  FROM (SELECT document_id, section, u, i, alone, CASE WHEN held = '' THEN u[i].body ELSE held || chr(10) || chr(10) || u[i].body END AS held, size + len({words_sql('u[i].body')}) AS size, a
        FROM (SELECT document_id, section, u, i, alone, CASE WHEN over THEN {_tail_sql('held')} ELSE held END AS held, CASE WHEN over THEN least({_SIZES.overlap}, len({words_sql('held')})) ELSE size END AS size,
                     CASE WHEN over OR alone AND held <> '' THEN held END AS a
              FROM (SELECT document_id, section, u, i + 1 AS i, held, size, u[i + 1].code AND len({words_sql('u[i + 1].body')}) > {_SIZES.most} AS alone,
                           held <> '' AND size + len({words_sql('u[i + 1].body')}) > {_SIZES.most} AS over FROM steps WHERE i < len(u))))
), pieces AS (
  SELECT document_id, section, i, 1 AS k, {_strip_sql('a')} AS content FROM steps WHERE a IS NOT NULL
  UNION ALL SELECT document_id, section, i, 2, {_strip_sql('b')} FROM steps WHERE b IS NOT NULL
  UNION ALL SELECT document_id, section, i, 3, {_strip_sql('held')} FROM steps WHERE i = len(u) AND held <> ''
), numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY section, i, k) - 1 AS chunk_index, sha256(content) AS content_hash FROM pieces)
SELECT 'chunk_' || substr(sha256(document_id || ':' || chunk_index::VARCHAR || ':' || content_hash), 1, 16) AS chunk_id, document_id, chunk_index, coalesce(heading_path, '') AS heading_path, content,
       {preview_sql('content')} AS preview, content_hash, len({words_sql('content')}) AS token_count FROM numbered LEFT JOIN paths USING (document_id, section)
"""


@registry.query("chunk_markdown", CHUNK_MARKDOWN_SQL)
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir, "md", _SIZES)


@registry.query(
    "tag_filter_all",
    f"""WITH {DOCS_SQL} SELECT id, project FROM docs WHERE status <> 'Deleted' AND project IS NOT NULL AND list_has_all(tags, ['internal', 'policy'])""",
)
def tag_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(F.lit("internal"), F.lit("policy"))
    kept = current_documents(spark, sf_dir).where(
        passes(F.col("status"), F.col("project"), F.col("tags"), F.col("source_path"), F.col("project"), tags, F.lit(None).cast("string"))
    )
    return kept.where(F.col("project").isNotNull()).select("id", "project")


_NORMAL_SQL = "lower(regexp_replace(replace({}, '\\', '/'), '^\\./', ''))"


@registry.query(
    "path_match",
    f"""WITH {DOCS_SQL}, pairs AS (SELECT DISTINCT c.chunk_id, {_NORMAL_SQL.format('c.source_path')} AS a, {_NORMAL_SQL.format('d.source_path')} AS b FROM chunks c JOIN docs d ON c.document_id = d.id)
        SELECT chunk_id, a AS indexed_path, a = b OR ends_with(a, '/' || b) OR string_split(a, '/')[-1] = string_split(b, '/')[-1] AS matches FROM pairs""",
)
def path_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each chunk's path agrees with that of the document it names."""
    docs = current_documents(spark, sf_dir).select(F.col("id").alias("document_id"), F.col("source_path").alias("expected"))
    pairs = table(spark, sf_dir, "chunks").select("chunk_id", "document_id", "source_path").distinct().join(docs, "document_id")
    return pairs.select("chunk_id", normal_path(F.col("source_path")).alias("indexed_path"), path_matches(F.col("source_path"), F.col("expected")).alias("matches")).distinct()


_EARLIER, _LATER = "2025-04-01", "2025-07-01"


def _state_sql(name: str, at: str) -> str:
    return f"{name} AS (SELECT id, arg_max(source_path, updated_at) AS source_path, arg_max(content_hash, updated_at) AS h, arg_max(status, updated_at) AS status FROM ingestion_docs WHERE updated_at < TIMESTAMPTZ '{at} 00:00:00+00' GROUP BY id)"


@registry.query(
    "ingest_outcomes",
    f"""WITH {_state_sql('old', _EARLIER)}, {_state_sql('new', _LATER)}, live AS (SELECT * FROM new WHERE status <> 'Deleted'),
        judged AS (SELECT l.id, CASE WHEN l.h = o.h AND o.status <> 'Deleted' THEN 'unchanged' ELSE 'changed' END AS outcome FROM live l LEFT JOIN old o ON l.source_path = o.source_path)
        SELECT * FROM judged UNION ALL SELECT o.id, 'deleted' FROM old o WHERE o.status <> 'Deleted' AND o.source_path NOT IN (SELECT source_path FROM live)""",
)
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ingestion on 1 July would make of the documents last ingested on 1 April."""
    def state(at: str) -> DataFrame:
        rows = table(spark, sf_dir, "ingestion_docs").where(F.col("updated_at") < F.lit(f"{at} 00:00:00").cast("timestamp"))
        newest = F.max_by(F.struct("source_path", "content_hash", "status", "created_at"), "updated_at").alias("x")
        return rows.groupBy("id").agg(newest).select("id", "x.*")

    old = state(_EARLIER)
    files = state(_LATER).where(F.col("status") != "Deleted").select(
        "id", "source_path", "content_hash", F.lit(None).cast("string").alias("skipped"), F.lit(None).cast("string").alias("error")
    )
    judged = file_outcomes(files, old)
    gone = missing_documents(old, judged, None)
    return judged.select("id", "outcome").unionByName(gone.select("id", F.lit("deleted").alias("outcome")))


@registry.query(
    "chunk_documents_join",
    f"""WITH {DOCS_SQL}, cur AS (SELECT DISTINCT chunk_id, document_id, token_count FROM chunks)
        SELECT coalesce(d.project, '') AS project, count(*) AS n_chunks, count(DISTINCT c.document_id) AS n_documents, sum(c.token_count) AS n_tokens
        FROM cur c JOIN docs d ON c.document_id = d.id WHERE d.status <> 'Deleted' GROUP BY ALL""",
)
def chunk_documents_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents that are there, per project."""
    docs = current_documents(spark, sf_dir).where(F.col("status") != "Deleted").select(F.col("id").alias("document_id"), "project")
    joined = current_chunks(spark, sf_dir).join(docs, "document_id")
    return joined.groupBy(F.coalesce("project", F.lit("")).alias("project")).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("document_id").alias("n_documents"), F.sum("token_count").alias("n_tokens")
    )
