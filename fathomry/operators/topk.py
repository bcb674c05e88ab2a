"""The best few records of each query, kept while a task reads its records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Queries searched at a time: more are searched in so many parts, one after another.
BATCH = 8192
# Cells of one block of scores.
CELLS = 4_000_000


def in_batches(queries: DataFrame, key: str, size: int = BATCH) -> list[DataFrame]:
    """The queries in parts of about ``size``, by a hash of their key; what a task holds is one part."""
    parts = -(-queries.count() // size)
    if parts <= 1:
        return [queries]
    at = F.pmod(F.xxhash64(key), F.lit(parts))
    return [queries.where(at == i) for i in range(parts)]


class Best:
    """Per query its ``depths[q]`` best records: greatest score, then least tie (null last), then least name."""

    def __init__(self, depths: np.ndarray):
        self.depths, self.floor = depths, np.full(len(depths), -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held, self.most = 0, max(1_000_000, 4 * int(depths.sum()))

    def add(self, scores: np.ndarray, names: np.ndarray, ties: np.ndarray, first: int = 0) -> None:
        """Scores of the queries from ``first`` on (rows) for some records (columns); -inf never counts."""
        rows, columns = scores.shape
        if not columns:
            return
        floor, depths = self.floor[first : first + rows], self.depths[first : first + rows]
        deepest = int(depths.max(initial=1))
        if deepest < columns:
            # The depth-th best of these records alone is a bound already.
            kth = np.partition(scores, columns - deepest, axis=1)[:, columns - deepest]
            np.maximum(floor, np.where(depths == deepest, kth, -np.inf), out=floor)
        q, at = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        self.parts.append((q + first, scores[q, at], names[at], ties[at]))
        self.held += len(q)
        if self.held > self.most:
            self._compact()

    def _compact(self) -> None:
        q, score, name, tie = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((-score, q))
        q, score, name, tie = q[order], score[order], name[order], tie[order]
        counts = np.bincount(q, minlength=len(self.depths))
        starts = np.cumsum(counts) - counts
        full = counts >= self.depths
        self.floor[full] = score[starts[full] + self.depths[full] - 1]
        kept = score >= self.floor[q]
        rows = pd.DataFrame({"q": q[kept], "far": -score[kept], "tie": tie[kept], "name": name[kept]}).sort_values(["q", "far", "tie", "name"], na_position="last", ignore_index=True)
        rows = rows[rows.groupby("q").cumcount().to_numpy() < self.depths[rows["q"]]]
        self.parts = [(rows["q"].to_numpy(), -rows["far"].to_numpy(), rows["name"].to_numpy(), rows["tie"].to_numpy())]
        self.held = len(rows)

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``query, score, name, tie``, once."""
        if self.parts:
            self._compact()
            yield self.parts[0]
