"""Deterministic identifiers: SHA-256 based, so that any SQL engine can check them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes and the number of hexadecimal digits kept.
DOCUMENT_PREFIX = "doc_"
CHUNK_PREFIX = "chunk_"
ID_DIGITS = 16


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def document_id(source_path: Column) -> Column:
    return F.concat(F.lit(DOCUMENT_PREFIX), F.substring(content_hash(source_path), 1, ID_DIGITS))


def chunk_id(document: Column, index: Column, digest: Column) -> Column:
    joined = F.concat_ws(":", document, index.cast("string"), digest)
    return F.concat(F.lit(CHUNK_PREFIX), F.substring(content_hash(joined), 1, ID_DIGITS))
