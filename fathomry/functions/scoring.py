"""Scores, candidate depths and explanations of a search, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking: similarity threshold, over-fetch factor, fusion constant and weights, keyword constants.
THRESHOLD = 0.30
OVERFETCH = 5
FUSION = 60
FUSION_WEIGHT = 0.5
K1 = 1.2
B = 0.75


def _column(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def fetch_depth(top_k: Column | int, filtered: Column | bool) -> Column:
    """Candidates to fetch: more where a filter will drop some, never less than one."""
    k = _column(top_k).cast("long")
    wide = filtered if isinstance(filtered, Column) else F.lit(filtered)
    return F.greatest(F.when(wide, k * OVERFETCH).otherwise(k), F.lit(1))


def hybrid_depth(top_k: Column | int, filtered: Column | bool) -> Column:
    return F.greatest(fetch_depth(top_k, filtered), _column(top_k).cast("long") * OVERFETCH, F.lit(OVERFETCH))


def fused_score(vector_rank: Column, keyword_rank: Column) -> Column:
    """Reciprocal-rank fusion, 1 for first in both lists; a missing rank adds nothing."""
    part = lambda rank: F.coalesce(F.lit(FUSION_WEIGHT) / (F.lit(FUSION) + rank), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (part(vector_rank) + part(keyword_rank)) * (FUSION + 1)))


def keyword_share(raw: Column, best: Column) -> Column:
    """A raw keyword score as a share of the best one fetched; 0 where that is not positive."""
    return F.when(best > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw / best))).otherwise(F.lit(0.0))


def clears_threshold(mode: Column | str, score: Column) -> Column:
    """Only vector scores have a threshold."""
    is_vector = (mode if isinstance(mode, Column) else F.lit(mode)) == "vector"
    return F.when(is_vector, score >= THRESHOLD).otherwise(F.lit(True))


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def term_score(tf: Column, length: Column, average: Column, weight: Column) -> Column:
    return weight * tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * length / average))


def explanation(vector_rank: Column, n_vector: Column, keyword_rank: Column, n_keyword: Column, filtered: Column) -> Column:
    """Why a result is eligible; parts about lists it is not in are left out."""
    return F.concat_ws(
        "; ",
        F.when(vector_rank.isNotNull(), F.format_string("knn #%d of %d vector candidates", vector_rank, n_vector)),
        F.when(keyword_rank.isNotNull(), F.format_string("keyword #%d of %d candidates", keyword_rank, n_keyword)),
        F.when(filtered, "passed active filter(s)").otherwise("passed no filter(s)"),
    )


def reciprocal_rank(rank: Column) -> Column:
    return F.coalesce(F.lit(1.0) / rank, F.lit(0.0))


def hit_at(rank: Column, k: int) -> Column:
    return F.coalesce(rank <= k, F.lit(False))


def filter_text(project: Column, tags: Column, source: Column) -> Column:
    """A filter in words: its parts, two blanks between them, or ``(none)``."""
    named = F.concat_ws(
        "  ", F.concat(F.lit("project="), project), F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.concat(F.lit("tag="), t)), F.concat(F.lit("source="), source)
    )
    return F.when(named == "", F.lit("(none)")).otherwise(named)
