"""Structured Streaming: continuous ingestion of files and running feedback counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomry.operators.ingest import Corpus
from fathomry.sources.files import parse_files


def stream_files(spark: SparkSession, root: str) -> DataFrame:
    """New files below a folder, as a stream of ``source_path, content, error``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    return found.select(F.regexp_replace("path", "^file:(//)?", "").alias("source_path"), "content", F.lit(None).cast("string").alias("error"))


def stream_ingest(spark: SparkSession, root: str, corpus: Corpus, checkpoint: str, **options) -> StreamingQuery:
    """Ingest whatever arrives, batch by batch; a batch that is repeated after a failure finds its files unchanged.

    Batches hold new files only, so nothing is taken for deleted.
    """

    def each(batch: DataFrame, number: int) -> None:
        at = batch.sparkSession.sql("select cast(current_timestamp() as string)").first()[0]
        corpus.ingest(parse_files(batch), at, root="\x00no folder", **options)

    return stream_files(spark, root).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feedback_counts(feedback: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Ratings per window of ``created_at`` (a timestamp) and mode, from a stream or a table; rows later than the watermark are dropped from a stream.

    Repeated deliveries of an item count once within the watermark.
    """
    timed = feedback.withWatermark("created_at", late).dropDuplicates(["id", "created_at"])
    return timed.groupBy(F.window("created_at", window).alias("w"), "search_mode").agg(
        F.count_if(F.col("rating") == "good").alias("good_count"), F.count_if(F.col("rating") == "bad").alias("bad_count")
    ).select(F.col("w.start").alias("window_start"), "search_mode", "good_count", "bad_count")
