"""Tolerant comparison of source paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """Forward slashes, one leading ``./`` stripped, lower case."""
    return F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", ""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_matches(indexed: Column, expected: Column) -> Column:
    """Equal once normalised, or ends with ``/`` + expected, or has the same file name."""
    a, b = normal_path(indexed), normal_path(expected)
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | (basename(a) == basename(b))


def extension(path: Column) -> Column:
    """Lower-case extension of the file name; empty if it has none (a leading dot makes none)."""
    return F.lower(F.regexp_extract(basename(F.replace(path, F.lit("\\"), F.lit("/"))), r"[^.]\.([^.]*)$", 1))


def under(path: Column, root: str) -> Column:
    """Whether a path lies under a root folder: the folder itself, or it with a separator."""
    base = root.rstrip("/")
    return (path == base) | path.startswith(base + "/")
