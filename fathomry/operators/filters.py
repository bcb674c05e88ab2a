"""Which candidates a query's filters let through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_filtered(project: Column, tags: Column, source: Column) -> Column:
    """Whether a query filters at all (which makes it fetch more)."""
    return project.isNotNull() | source.isNotNull() | (F.coalesce(F.size(tags), F.lit(0)) > 0)


def passes(status: Column, doc_project: Column, doc_tags: Column, hit_source: Column, project: Column, tags: Column, source: Column) -> Column:
    """Not deleted, of the asked project, with all asked tags, and from the asked source path. A null never matches a filter."""
    asked_tags = F.coalesce(tags, F.array().cast("array<string>"))
    return (
        F.coalesce(status != "Deleted", F.lit(True))
        & F.coalesce(project.isNull() | (doc_project == project), F.lit(False))
        & F.coalesce(F.forall(asked_tags, lambda t: F.coalesce(F.array_contains(doc_tags, t), F.lit(False))), F.lit(True))
        & F.coalesce(source.isNull() | (hit_source == source), F.lit(False))
    )
