"""Incremental ingestion: what became of each file, new chunks, deletions, and the summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.functions.paths import under
from fathomry.functions.vectors import mock_embedding
from fathomry.operators.chunking import ChunkingConfig, chunk_documents
from fathomry.session import settle
from fathomry.sources.store import VersionedTable, check_dimension

DOCUMENTS = (
    "id string, source_path string, file_name string, file_extension string, content_hash string, title string, project string, tags array<string>, "
    "status string, embedding_model string, embedding_dimension int, created_at timestamp, updated_at timestamp, deleted_at timestamp"
)
CHUNKS = (
    "chunk_id string, document_id string, source_path string, chunk_index int, heading_path array<string>, content string, preview string, content_hash string, "
    "token_count int, metadata map<string,string>"
)
VECTORS = "chunk_id string, document_id string, vector array<double>"
OUTCOMES = ("skipped", "errored", "unchanged", "empty", "ingested", "deleted")


def file_outcomes(parsed: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Parsed files with ``outcome``: skipped, errored, unchanged or changed.

    A stored file with the same content is unchanged unless it was deleted, which
    restores it, or ``force`` is set.
    """
    known = stored.select("source_path", F.col("content_hash").alias("stored_hash"), F.col("status").alias("stored_status"), F.col("created_at").alias("first_seen"))
    joined = parsed.join(known, "source_path", "left")
    same = F.coalesce((F.col("content_hash") == F.col("stored_hash")) & (F.col("stored_status") != "Deleted"), F.lit(False))
    outcome = (
        F.when(F.col("skipped").isNotNull(), "skipped").when(F.col("error").isNotNull(), "errored").when(same & F.lit(not force), "unchanged").otherwise("changed")
    )
    return joined.withColumn("outcome", outcome)


def missing_documents(stored: DataFrame, outcomes: DataFrame, root: str | None) -> DataFrame:
    """Stored documents under the root that are not deleted and were not seen; files that could not be read count as not seen."""
    live = stored.where(F.coalesce(F.col("status") != "Deleted", F.lit(True)))
    if root is not None:
        live = live.where(under(F.col("source_path"), root))
    seen = outcomes.where(F.col("outcome").isin("unchanged", "changed", "empty", "ingested")).select("source_path")
    return live.join(seen, "source_path", "left_anti")


def summary(outcomes: DataFrame, n_chunks: DataFrame, deleted: DataFrame) -> DataFrame:
    """One row of counters: ``n_files`` and one per outcome, and ``n_chunks``."""
    counts = outcomes.agg(F.count(F.lit(1)).alias("n_files"), *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES[:-1]])
    return counts.select(
        "*", n_chunks.agg(F.count(F.lit(1))).scalar().alias("n_chunks"), deleted.agg(F.count(F.lit(1))).scalar().alias("n_deleted")
    )


def chunk_metadata(model: str, dimension: int) -> Column:
    """The fixed metadata keys of a chunk; a title only where there is one."""
    pairs = [("source_path", F.col("source_path")), ("char_length", F.length("content").cast("string")), ("embedding_model", F.lit(model)), ("embedding_dimension", F.lit(str(dimension))), ("title", F.col("title"))]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


class Corpus:
    """Documents, chunks and vectors below one folder; ``ingest`` brings them up to date with a table of parsed files."""

    def __init__(self, spark: SparkSession, root: str, config: ChunkingConfig = ChunkingConfig(), model: str = "mock", dimension: int = 32, embed: Callable[[Column], Column] | None = None):
        self.spark, self.config, self.model, self.dimension = spark, config, model, dimension
        self.embed = embed or (lambda text: mock_embedding(text, dimension))
        self.documents = VersionedTable(spark, f"{root}/documents", DOCUMENTS, "source_path")
        self.chunks = VersionedTable(spark, f"{root}/chunks", CHUNKS, "document_id")
        self.vectors = VersionedTable(spark, f"{root}/vectors", VECTORS, "document_id")

    def ingest(self, parsed: DataFrame, now: str, root: str | None = None, project: str | None = None, tags: tuple[str, ...] = (), force: bool = False, dry_run: bool = False) -> DataFrame:
        """Ingest parsed files (see ``parse_files``); returns the summary.

        Only new and changed files are chunked and embedded. A file that became
        empty keeps its record (Modified) and loses its chunks. Files that are
        gone are marked deleted with their time. A dry run changes nothing and
        deletes nothing.
        """
        stored = self.documents.read()
        judged = settle(file_outcomes(parsed, stored, force))
        changed = judged.where(F.col("outcome") == "changed")
        pieces = settle(chunk_documents(changed.select("document_id", "extension", "text"), self.config))
        held = pieces.select("document_id").distinct().withColumn("held", F.lit(True))
        final = judged.join(held, "document_id", "left").withColumn(
            "outcome", F.when(F.col("outcome") == "changed", F.when(F.col("held"), "ingested").otherwise("empty")).otherwise(F.col("outcome"))
        )
        final = settle(final)
        gone = settle(missing_documents(stored, final, root)) if not dry_run else stored.limit(0)
        report = summary(final, pieces, gone)
        if dry_run:
            return report
        report = settle(report)
        time = F.lit(now).cast("timestamp")
        touched = final.where(F.col("outcome").isin("ingested", "empty"))
        # An empty file that was never stored leaves no record.
        records = touched.where((F.col("outcome") == "ingested") | F.col("stored_hash").isNotNull()).select(
            F.col("document_id").alias("id"), "source_path", "file_name", F.col("extension").alias("file_extension"), "content_hash", "title",
            F.lit(project).cast("string").alias("project"), F.array(*map(F.lit, tags)).cast("array<string>").alias("tags"),
            F.when(F.col("outcome") == "empty", "Modified").otherwise("Active").alias("status"), F.lit(self.model).alias("embedding_model"),
            F.lit(self.dimension).alias("embedding_dimension"), F.coalesce("first_seen", time).alias("created_at"), time.alias("updated_at"), F.lit(None).cast("timestamp").alias("deleted_at"),
        )
        marked = gone.withColumn("status", F.lit("Deleted")).withColumn("deleted_at", time).withColumn("updated_at", time)
        about = touched.select("document_id", "source_path", "title")
        enriched = pieces.join(about, "document_id").withColumn("metadata", chunk_metadata(self.model, self.dimension)).drop("title")
        dropped = touched.select("document_id").unionByName(gone.select(F.col("id").alias("document_id")))
        embedded = enriched.select("chunk_id", "document_id", self.embed(F.col("content")).alias("vector"))
        self.vectors.replace(check_dimension(embedded, "vector", self.dimension), dropped)
        self.chunks.replace(enriched, dropped)
        # The document table goes last: an ingestion that dies before it is done again.
        self.documents.upsert(records.unionByName(marked.select(*records.columns)))
        return report
