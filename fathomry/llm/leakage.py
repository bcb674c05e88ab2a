"""Evaluation texts leaking into training text, by winnowed fingerprints.

Every text is cut into k-grams of words (ASCII letter and digit runs, without
case); of each window of w consecutive k-gram hashes the least is kept. Two
texts that share w + k - 1 consecutive words share a whole window, hence a
fingerprint, so looking up fingerprints misses no shared span of that length.
The hits are then extended along their diagonal and measured exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.functions.text import LOWER, UPPER
from fathomry.session import spread

K = 5
SHARED = 12
# Bytes of the items' texts that tasks hold at a time; more items are looked up in so many parts.
PART = 16_000_000

TOKEN = re.compile("[a-z0-9]+")
FOLD = str.maketrans(UPPER, LOWER)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.translate(FOLD)) if text else []


@lru_cache(maxsize=200_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def gram_hashes(words: list[str], k: int) -> np.ndarray:
    """A hash of every k-gram, in order."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
            out ^= out >> np.uint64(29)
    return out


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the kept hashes: the rightmost least one of every window of ``w``.

    A text with fewer hashes than a window keeps its least one.
    """
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    if n <= w:
        return np.array([n - 1 - int(hashes[::-1].argmin())])
    windows = np.lib.stride_tricks.sliding_window_view(hashes, w)[:, ::-1]
    return np.unique(np.arange(w - 1, n) - windows.argmin(axis=1))


def longest_run(a: list[str], b: list[str], diagonal: int) -> tuple[int, int]:
    """Length and start (in ``b``) of the longest run of equal words with position in a = position in b + diagonal."""
    best = start = run = 0
    for j in range(max(0, -diagonal), min(len(b), len(a) - diagonal)):
        run = run + 1 if a[j + diagonal] == b[j] else 0
        if run > best:
            best, start = run, j - run + 1
    return best, start


LEAKS = "doc_id long, item_id long, shared_words int, doc_start int, item_start int, item_words int"


class Index:
    """The kept fingerprints of some items, in order, with the item and the word each starts at."""

    def __init__(self, items: list[tuple[int, str]], k: int, shared: int):
        self.k, self.shared, self.ids, self.words = k, shared, [i for i, _ in items], [tokens(t) for _, t in items]
        found = [gram_hashes(w, k) for w in self.words]
        kept = [winnow(h, shared - k + 1) for h in found]
        fps = np.concatenate([h[p] for h, p in zip(found, kept)]) if items else np.empty(0, np.uint64)
        order = np.argsort(fps, kind="stable")
        self.fps = fps[order]
        self.item = np.repeat(np.arange(len(items)), [len(p) for p in kept])[order]
        self.pos = (np.concatenate(kept) if items else np.empty(0, np.int64))[order]

    def spans(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """``item, length, start in the text, start in the item, words of the item`` of the longest shared span with each item."""
        words = tokens(text)
        hashes = gram_hashes(words, self.k)
        kept = winnow(hashes, self.shared - self.k + 1)
        low, high = np.searchsorted(self.fps, hashes[kept], "left"), np.searchsorted(self.fps, hashes[kept], "right")
        times = high - low
        if not times.any():
            return []
        at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        hits = np.unique(np.column_stack([self.item[at], np.repeat(kept, times) - self.pos[at]]), axis=0)
        best: dict[int, tuple[int, int, int]] = {}
        for item, diagonal in hits.tolist():
            run, start = longest_run(words, self.words[item], diagonal)
            if run >= self.shared:
                best[item] = max(best.get(item, (0, 0, 0)), (run, -(start + diagonal), -start))
        return [(self.ids[i], run, -doc, -start, len(self.words[i])) for i, (run, doc, start) in best.items()]


LEAKS = "doc_id long, item_id long, shared_words int, doc_start int, item_start int, item_words int"


def _scan(batches: Iterator[pd.DataFrame], index: Index) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(doc, *span) for doc, text in zip(batch["doc_id"], batch["text"]) for span in index.spans(text)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEAKS.split(", ")])


def _parts(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of about ``most`` bytes of text, by a hash of their id."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = -(-size // most)
    at = F.pmod(F.xxhash64("id"), F.lit(max(1, count)))
    for part in range(count):
        yield [(r.id, r.text) for r in (items if count == 1 else items.where(at == part)).collect()]


def leaks(
    documents: DataFrame, items: DataFrame, doc: str = "doc_id", doc_text: str = "text", item: str = "item_id", item_text: str = "text", k: int = K, shared: int = SHARED, part: int = PART
) -> DataFrame:
    """``doc_id, item_id, shared_words, doc_start, item_start, item_words``: the longest shared span of each pair.

    One row per document and item that share at least ``shared`` consecutive
    words. Ids must be castable to bigint; null ids and texts give nothing, and
    of repeated ids the longest span counts. The items' fingerprints and words
    are sent to every task, in parts of about ``part`` bytes of text, each of
    which the documents are read against once; a document is fingerprinted, looked
    up and extended where it is read, so that nothing of it moves but the spans
    found. Of equally long spans the first one in the document is reported.
    """
    if shared < k:
        raise ValueError("shared spans must be at least k words")
    spark = documents.sparkSession
    asked = items.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("text"))
    texts = documents.where(F.col(doc).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    found = [spark.createDataFrame([], LEAKS)]
    for held in _parts(asked, part):
        index = spark.sparkContext.broadcast(Index(held, k, shared))
        found.append(spread(texts).mapInPandas(lambda batches, index=index: _scan(batches, index.value), LEAKS))
    best = F.max(F.struct("shared_words", (-F.col("doc_start")).alias("s"), (-F.col("item_start")).alias("i"), "item_words")).alias("best")
    return reduce(DataFrame.unionByName, found[1:] or found).groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.shared_words", (-F.col("best.s")).alias("doc_start"), (-F.col("best.i")).alias("item_start"), "best.item_words"
    )
