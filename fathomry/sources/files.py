"""Reading folders of files as a table."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.functions.ids import content_hash, document_id
from fathomry.functions.paths import basename, extension
from fathomry.functions.text import markdown_title
from fathomry.operators.chunking import MARKDOWN, PLAIN

FILES = "source_path string, content binary, error string"


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """``source_path, content, error`` of every regular file below a folder that all executors see.

    Links are not followed, hidden files are read too, and a file that cannot be
    read has an error instead of content. An empty or missing folder has no rows.
    Names are listed by the driver; contents are read by the executors.
    """
    names = [os.path.join(base, f) for base, _, files in os.walk(root) for f in files]
    names = sorted(n for n in names if os.path.isfile(n) and not os.path.islink(n))
    if not names:
        return spark.createDataFrame([], FILES)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["source_path"]:
                try:
                    with open(name, "rb") as f:
                        rows.append((name, f.read(), None))
                except OSError as error:
                    rows.append((name, None, str(error)))
            yield pd.DataFrame(rows, columns=["source_path", "content", "error"])

    listed = spark.createDataFrame([(n,) for n in names], "source_path string")
    return listed.repartition(max(1, min(len(names) // 64, 10_000)) or 1).mapInPandas(read, FILES)


def scan_distributed(spark: SparkSession, root: str) -> DataFrame:
    """The same through Spark's own file source, for stores that a driver should not walk; it leaves out empty files and names with a leading dot or underscore."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(F.regexp_replace("path", "^file:(//)?", "").alias("source_path"), "content", F.lit(None).cast("string").alias("error"))


def parser_of(ext: Column) -> Column:
    """Which parser reads files of an extension; null where none does."""
    return F.when(ext.isin(*MARKDOWN), "markdown").when(ext.isin(*PLAIN), "text")


def skip_reason(ext: Column) -> Column:
    return F.when(parser_of(ext).isNull(), F.concat(F.lit("unsupported extension '."), ext, F.lit("'")))


def parse_files(files: DataFrame) -> DataFrame:
    """Files with their ids, hash, text and title; ``skipped`` and ``error`` say why one has no text.

    Unknown extensions are skipped; bytes that are not UTF-8 are an error. The
    title is a Markdown file's first level-one heading.
    """
    ext = extension(F.col("source_path"))
    known, skipped = parser_of(ext).isNotNull(), skip_reason(ext)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    error = F.when(known, F.coalesce("error", F.when(F.col("content").isNull(), "no content"), F.when(~valid, "not valid UTF-8")))
    text = F.when(known & error.isNull(), F.col("content").cast("string"))
    return files.select(
        "source_path", document_id(F.col("source_path")).alias("document_id"), basename(F.col("source_path")).alias("file_name"), ext.alias("extension"),
        content_hash(F.col("content")).alias("content_hash"), text.alias("text"), F.when(ext.isin(*MARKDOWN), markdown_title(text)).alias("title"),
        skipped.alias("skipped"), error.alias("error"),
    )
