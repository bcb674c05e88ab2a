"""Splitting oversized items at natural boundaries, by recursive bisection.

An item is cut at the strongest boundary near its middle, and halves that still
exceed the limit less the overlap are cut again; each piece but the first then
gets the words before it as overlap. Sizes are words separated by Unicode white
space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The characters with the Unicode property White_Space (not those Python adds to it).
WHITE_SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

WORD = re.compile(f"[^{WHITE_SPACE}]+")
LINE_BREAK = re.compile("\r\n|[\n\x0b\x0c\r\x85" + chr(0x2028) + chr(0x2029) + "]")
FENCE = re.compile(r"[ \t]*(```|~~~)")
STRUCTURAL = re.compile(r"(#{1,6}$|[-*+]$|\d+[.)]$|\||>)")
SENTENCE_END = re.compile(r"[.!?。！？…]+[\"')\]»”’*_`]*$")
CLAUSE_END = re.compile(r"[,;:—–][\"')\]»”’]*$")

# Strength of a cut before a word, weakest first.
INSIDE, CLAUSE, SENTENCE, LINE, BLOCK, PARAGRAPH = range(1, 7)
NAMES = {0: "start", INSIDE: "word", CLAUSE: "clause", SENTENCE: "sentence", LINE: "line", BLOCK: "block", PARAGRAPH: "paragraph"}


def boundaries(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """The words' spans and, for each, the strength of a cut before it (0 for the first).

    Blank lines are strongest, then lines that open a heading, list item, table
    row or quotation, other line ends, sentence ends, clause ends, and any word.
    Inside a code fence only lines and blank lines count, less than any boundary
    outside, so that code is cut last.
    """
    spans = [m.span() for m in WORD.finditer(text)]
    cuts, fenced, end = [], False, 0
    for k, (a, b) in enumerate(spans):
        gap = text[end:a]
        breaks = len(LINE_BREAK.findall(gap)) if k else 0
        opens = bool(breaks or not k) and FENCE.match(text, a) is not None
        if not k:
            cuts.append(0)
        elif fenced:
            # The closing fence belongs to its block.
            cuts.append(INSIDE if opens or not breaks else CLAUSE if breaks == 1 else SENTENCE)
        elif breaks > 1:
            cuts.append(PARAGRAPH)
        elif breaks:
            cuts.append(BLOCK if opens or STRUCTURAL.match(text[a:b]) else LINE)
        else:
            before = text[max(0, end - 12) : end]
            cuts.append(SENTENCE if SENTENCE_END.search(before) else CLAUSE if CLAUSE_END.search(before) else INSIDE)
        if opens:
            fenced = not fenced
        end = b
    return spans, cuts


def bisect(cuts: list[int], most: int) -> list[int]:
    """Where pieces of at most ``most`` words begin.

    A part of n words is cut where both halves get at least a quarter: at the
    strongest boundary there, of several the one nearest the middle, of two the
    earlier one.
    """
    starts, parts = [], [(0, len(cuts))]
    while parts:
        lo, hi = parts.pop()
        size = hi - lo
        if size <= most:
            starts.append(lo)
            continue
        reach = max(1, size // 4)
        low, high, middle = lo + reach, hi - reach, lo + size / 2
        at = max(range(low, high + 1), key=lambda i: (cuts[i] if i < hi else -1, -abs(i - middle), -i))
        parts += [(at, hi), (lo, at)]
    return starts


def split(text: str | None, limit: int | None, overlap: int | None) -> list[dict]:
    """The pieces of a text: ``start, end, body_start, tokens, overlap, boundary`` in characters and words.

    A text within the limit is one piece, as is any text where the limit is null
    or below 1; an empty or null text gives none. A negative or null overlap is
    0, and one of the limit or more is the limit less 1. Bodies cover every word
    once and in order, so that joining them with the blanks between gives the
    text back.
    """
    if not text:
        return []
    spans, cuts = boundaries(text)
    if not spans:
        return []
    n = len(spans)
    limit = int(limit) if limit is not None and limit == limit and limit >= 1 else n
    overlap = min(max(0, int(overlap) if overlap is not None and overlap == overlap else 0), limit - 1)
    starts = [0] if n <= limit else bisect(cuts, max(1, limit - overlap))
    pieces = []
    for k, lo in enumerate(starts):
        hi = starts[k + 1] if k + 1 < len(starts) else n
        first = max(0, lo - overlap)
        pieces.append(
            {"start": spans[first][0], "end": spans[hi - 1][1], "body_start": spans[lo][0], "tokens": hi - first, "overlap": lo - first, "boundary": NAMES[cuts[lo] if k else 0]}
        )
    return pieces


PIECES = (
    "record string, piece int, pieces int, heading_path array<string>, content string, token_count int, overlap_count int, boundary string, "
    "body_start int, body_end int"
)


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [part.split()[0] for part in PIECES.split(", ")]
    for batch in batches:
        rows = []
        for record, text, heading, limit, overlap in zip(batch["record"], batch["content"], batch["heading_path"], batch["most"], batch["overlap"]):
            found = split(text, limit, overlap)
            for k, p in enumerate(found):
                rows.append((record, k, len(found), heading, text[p["start"] : p["end"]], p["tokens"], p["overlap"], p["boundary"], p["body_start"], p["end"]))
        yield pd.DataFrame(rows, columns=columns)


def may_exceed(text, limit):
    """False only where a text cannot hold more than ``limit`` words: n words take 2n - 1 characters."""
    return F.length(text) > 2 * limit


def split_oversized(items: DataFrame, configs: DataFrame, record: str = "chunk_id", text: str = "content", heading: str = "heading_path", config: str = "config_name") -> DataFrame:
    """The pieces of every item over its config's ``max_tokens``, with ``overlap_tokens`` of overlap.

    Items within their limit, without a config or with a null text need no
    splitting and give no rows. Repeated rows of an item (same record and text)
    count once; the same record with another text or config is another item.
    Heading paths are carried over, null ones as null. Lengths decide most items
    in the JVM; only those that may exceed their limit reach Python.
    """
    limits = configs.select(F.col(config).alias("config"), F.col("max_tokens").alias("most"), F.col("overlap_tokens").alias("overlap")).where(F.col("most") >= 1).dropDuplicates(["config"])
    picked = items.where(F.col(record).isNotNull() & F.col(text).isNotNull()).select(
        F.col(record).alias("record"), F.col(text).alias("content"), F.col(heading).alias("heading_path"), F.col(config).alias("config")
    )
    large = picked.join(limits, "config").where(may_exceed(F.col("content"), F.col("most")))
    # Repeats are dropped among the large items only, merged map-side first.
    once = large.groupBy("record", "content", "most", "overlap").agg(F.max("heading_path").alias("heading_path"))
    return once.select("record", "content", "heading_path", "most", "overlap").mapInPandas(_split_batches, PIECES).where(F.col("pieces") > 1)
