"""Heading-aware chunking of documents into overlapping pieces.

Splitting a document depends on what was packed before (the overlap seeds the
next chunk), so it runs per document in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.functions.ids import CHUNK_PREFIX, ID_DIGITS
from fathomry.functions.text import PREVIEW_CHARS, PREVIEW_MARK

# The characters with the Unicode property White_Space, extensions parsed as Markdown and as text, and code fences.
BLANKS = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
MARKDOWN = ("md",)
PLAIN = ("txt", "json", "yaml", "yml")
FENCES = ("```", "~~~")
MAX_HEADING = 6

_TO_SPACE = str.maketrans(BLANKS, " " * len(BLANKS))


@dataclass(frozen=True)
class ChunkingConfig:
    """Sizes in words. ``drop_tails`` leaves out chunks that only repeat the overlap; ``split_oversized`` cuts paragraphs over the limit at words."""

    target: int = 500
    most: int = 800
    overlap: int = 80
    drop_tails: bool = False
    split_oversized: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.target < self.most:
            raise ValueError(f"overlap < target < most must hold: {self.overlap}, {self.target}, {self.most}")


def words(text: str) -> list[str]:
    return [w for w in text.translate(_TO_SPACE).split(" ") if w]


def _lines(text: str) -> list[str]:
    """Lines end at a newline, less one carriage return before it; a final newline starts no line."""
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


@dataclass
class Section:
    path: list[str]
    units: list[tuple[bool, str]]  # (is code, text)


def sections(text: str, markdown: bool) -> list[Section]:
    """Sections of paragraphs and code blocks; plain text is one section without headings.

    Any fence line ends an open fence, whatever its marks; an open one runs to
    the end. A heading needs no blank after its signs; more than six are text.
    """
    done: list[Section] = []
    trail: list[tuple[int, str]] = []
    here = Section([], [])
    paragraph: list[str] = []
    code: list[str] | None = None

    def end_paragraph() -> None:
        joined = "\n".join(paragraph).strip(BLANKS)
        if joined:
            here.units.append((False, joined))
        paragraph.clear()

    for line in _lines(text):
        bare = line.lstrip(BLANKS)
        if markdown and bare.startswith(FENCES):
            if code is None:
                end_paragraph()
                code = [line]
            else:
                here.units.append((True, "\n".join([*code, line]).rstrip(BLANKS)))
                code = None
            continue
        if code is not None:
            code.append(line)
            continue
        level = len(bare) - len(bare.lstrip("#"))
        if markdown and 1 <= level <= MAX_HEADING:
            end_paragraph()
            if here.units:
                done.append(here)
            trail = [t for t in trail if t[0] < level]
            trail.append((level, bare[level:].strip(BLANKS)))
            here = Section([title for _, title in trail], [])
        elif bare:
            paragraph.append(line)
        else:
            end_paragraph()
    if code is not None:
        here.units.append((True, "\n".join(code).rstrip(BLANKS)))
    end_paragraph()
    if here.units:
        done.append(here)
    return done


def _cut(text: str, most: int) -> list[str]:
    all_words = words(text)
    return [" ".join(all_words[i : i + most]) for i in range(0, len(all_words), most)]


def pack(section: Section, config: ChunkingConfig) -> list[str]:
    """Contents of a section's chunks.

    Units fill a chunk until it reaches the target; one that would exceed the
    limit goes to the next. Each chunk starts with the last words of the one
    before, except after a code block over the limit, which stands alone.
    """
    out: list[str] = []
    held: list[str] = []
    size = 0
    fresh = False  # whether anything but the overlap is held

    def emit() -> None:
        nonlocal held, size, fresh
        joined = "\n\n".join(held)
        content = joined.strip(BLANKS)
        if content:
            if fresh or not config.drop_tails:
                out.append(content)
            tail = words(joined)[-config.overlap :] if config.overlap else []
            held, size = ([" ".join(tail)] if tail else []), len(tail)
        else:
            held, size = [], 0
        fresh = False

    for is_code, unit in section.units:
        count = len(words(unit))
        if is_code and count > config.most:
            if held:
                emit()
            out.append(unit.strip(BLANKS))
            held, size, fresh = [], 0, False
            continue
        parts = _cut(unit, config.most - config.overlap) if config.split_oversized and count > config.most else [unit]
        for part in parts:
            n = len(words(part))
            if held and size + n > config.most:
                emit()
            held.append(part)
            size += n
            fresh = True
            if size >= config.target:
                emit()
    emit()
    return out


def preview_of(content: str) -> str:
    flat = " ".join(words(content))
    return flat if len(flat) <= PREVIEW_CHARS else flat[:PREVIEW_CHARS] + PREVIEW_MARK


CHUNKS = "chunk_id string, document_id string, chunk_index int, heading_path array<string>, content string, preview string, content_hash string, token_count int"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _chunk(config: ChunkingConfig):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for document, kind, text in zip(batch["document_id"], batch["extension"], batch["text"]):
                index = 0
                for section in sections(text or "", kind in MARKDOWN):
                    for content in pack(section, config):
                        digest = _digest(content)
                        key = _digest(f"{document}:{index}:{digest}")[:ID_DIGITS]
                        rows.append((CHUNK_PREFIX + key, document, index, section.path, content, preview_of(content), digest, len(words(content))))
                        index += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return each


def chunk_documents(documents: DataFrame, config: ChunkingConfig = ChunkingConfig()) -> DataFrame:
    """Chunks (``CHUNKS``) of documents ``document_id, extension, text``.

    Markdown is split at headings and code stays whole; other text only at blank
    lines. Blank and null texts have no chunks. Other columns are not looked at.
    """
    return documents.select("document_id", "extension", "text").mapInPandas(_chunk(config), CHUNKS)
