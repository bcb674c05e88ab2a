"""Markup residue in text: find it, and turn marked-up text into clean text that keeps its structure.

A bidirectional LSTM reads a text's leaves from end to end (structure paths and
hashed words) and says of each which formats it is marked up in and what kind of
block it is. Its labels alone decide which texts hold which markup, and choose
how each leaf is cleaned.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.llm.bilstm import Labeller, pad
from fathomry.llm.leaves import SIGNS, TAGS, WIDTH, Leaf, leaves, vectors
from fathomry.llm.markup_samples import BLOCKS, FORMATS, Sample, samples
from fathomry.session import spread


@dataclass(frozen=True)
class Settings:
    """``samples`` bounds the labelled texts the model is trained on; they are made, not drawn from the data."""

    samples: int = 3000
    size: int = 20
    epochs: int = 9
    batch: int = 32
    rate: float = 0.01
    seed: int = 11
    # A format is said if its probability is at least this; below a half, as one of many leaves is enough to find a text's format and few are marked.
    threshold: float = 0.4


def targets(sample: Sample, found: list[Leaf]) -> tuple[np.ndarray, np.ndarray]:
    """Labels of a sample's leaves, from the spans they overlap."""
    flags, classes = np.zeros((len(found), len(FORMATS)), np.float32), np.zeros(len(found), np.int64)
    for i, leaf in enumerate(found):
        body = len(sample.text[leaf.start : leaf.end].strip())
        for start, end, formats, block in sample.spans:
            shared = sample.text[max(start, leaf.start) : min(end, leaf.end)].strip() if start < leaf.end and end > leaf.start else ""
            if shared and formats:
                for f in formats:
                    flags[i, FORMATS.index(f)] = 1.0
                if 2 * len(shared) >= body:
                    classes[i] = BLOCKS.index(block)
    return flags, classes


@lru_cache(maxsize=4)
def trained(settings: Settings = Settings()) -> Labeller:
    """The labeller, trained once per process and settings; the same settings give the same weights."""
    data = [(s, leaves(s.text)) for s in samples(settings.samples, settings.seed)]
    data = [(s, found) for s, found in data if found]
    labels = [targets(s, found) for s, found in data]
    model = Labeller.new(WIDTH, settings.size, len(FORMATS), len(BLOCKS), settings.seed)
    model.train([vectors(s.text, found) for s, found in data], [f for f, _ in labels], [c for _, c in labels], settings.epochs, settings.batch, settings.rate, settings.seed)
    return model


def label(model: Labeller, texts: list[str], cells: int = 200_000) -> list[tuple[list[Leaf], np.ndarray, np.ndarray]]:
    """Leaves, format probabilities and block classes of each text; texts of like length run together."""
    found = [leaves(t) for t in texts]
    out: list = [(f, np.zeros((0, len(FORMATS)), np.float32), np.zeros(0, np.int64)) for f in found]
    order = sorted((i for i in range(len(texts)) if found[i]), key=lambda i: len(found[i]))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop - start + 1) * len(found[order[stop]]) <= cells // 8 and stop - start < 512:
            stop += 1
        part = order[start:stop]
        x, lengths = pad([vectors(texts[i], found[i]) for i in part])
        flags, classes = model.scores(x, lengths)
        for k, i in enumerate(part):
            n = int(lengths[k])
            out[i] = (found[i], flags[k, :n], classes[k, :n].argmax(axis=1))
        start = stop
    return out


_MAGIC = r"__(?:[A-Z]{3,}(?:_[A-Z]+)*)__"


def formats_of(flags: np.ndarray, threshold: float) -> list[frozenset[str]]:
    """Per leaf, the formats that the labeller says."""
    return [frozenset(f for f, v in zip(FORMATS, p) if v >= threshold) for p in flags]


def _plain_html(s: str) -> str:
    s = re.sub(r"<!--.*?-->|<!--.*$|^.*?-->", "", s, flags=re.DOTALL) if "<!--" in s or "-->" in s else s
    s = re.sub(r"<(?:br|hr)\s*/?>|</(?:p|div|li|tr|h[1-6]|table|ul|ol)>", "\n", s, flags=re.IGNORECASE)
    s = re.sub(r"<li[^<>]*>", "\n- ", s, flags=re.IGNORECASE)
    s = re.sub(r"</t[dh]>\s*<t[dh][^<>]*>", " | ", s, flags=re.IGNORECASE)
    s = re.sub(r"<img[^<>]*?alt=[\"']([^\"']*)[\"'][^<>]*>", r"\1", s, flags=re.IGNORECASE)
    s = re.sub(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>", lambda m: "" if m.group(1).lower() in TAGS else m.group(0), s)
    return entities.unescape(s)


def _plain_markdown(s: str, block: str) -> str:
    if block == "table" or re.match(r"^\s*\|", s):
        return "" if re.fullmatch(r"[\s|:-]+", s) else s.strip().strip("|").strip()
    s = re.sub(r"^\s{0,3}#{1,6}\s+|\s+#+\s*$", "", s)
    s = re.sub(r"^\s{0,3}>+\s?", "", s)
    s = re.sub(r"^(\s*)[*+]\s+", r"\1- ", s)
    s = re.sub(r"^(\s*- )\[[ xX]\]\s+", r"\1", s)
    s = re.sub(r"!?\[([^\]\n]*)\]\([^()\s]+(?:\s+\"[^\"]*\")?\)", r"\1", s)
    s = re.sub(r"\[\^[^\]\s]+\]", "", s)
    s = re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", s)
    for mark in (r"\*\*", "__", "~~"):
        s = re.sub(rf"(?<![\w]){mark}(\S(?:.*?\S)?){mark}(?!\w)", r"\1", s)
    s = re.sub(r"(?<![\w*])\*([^\s*](?:[^*]*[^\s*])?)\*(?![\w*])", r"\1", s)
    s = re.sub(r"(?<![\w_])_([^\s_](?:[^_]*[^\s_])?)_(?![\w_])", r"\1", s)
    return "" if re.fullmatch(r"\s*(?:[=-]{3,}|\[[^\]]+\]:\s*\S+)\s*", s) else s


def _plain_wiki(s: str) -> str:
    s = re.sub(rf"\[\[(?:File|Image|Category):[^\[\]]*\]\]|{_MAGIC}", "", s)
    s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", s)
    s = re.sub(r"\{\{[^{}]*\}\}", "", s)
    s = re.sub(r"^\s*(?:\{\{.*|\}\}|\{\|.*|\|\}|\|-.*)$", "", s)
    s = re.sub(r"^\s*\|\s*([\w ]+?)\s*=\s*(.*)$", r"\1: \2", s)
    s = re.sub(r"^\s*[|!]\s*", "", s)
    s = re.sub(r"\[https?://\S+ ([^\]]+)\]", r"\1", s)
    s = re.sub(r"^\s*(={2,6})\s*(.*?)\s*\1\s*$", r"\2", s)
    return re.sub(r"'{2,5}", "", s)


def _plain_latex(s: str) -> str:
    """Commands give way to what they hold; formulas stay as they are written."""
    formulas: list[str] = []

    def hold(m: re.Match) -> str:
        formulas.append(m.group(0))
        return f"\x00{len(formulas) - 1}\x00"

    s = re.sub(r"\\\[.*?\\\]|\\\(.*?\\\)|\$\$.*?\$\$|\$[^$\n]+\$", hold, s)
    s = re.sub(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\{[^{}]*\})?|\\(?:label|hline|centering)(?:\{[^{}]*\})?", "", s)
    s = re.sub(r"^\s*\\item\s*", "- ", s)
    s = re.sub(r"~?\\(?:ref|cite|eqref)\{([^{}]*)\}", r" [\1]", s)
    for _ in range(4):
        s = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", s)
    s = s.replace("\\\\", "").replace("~", " ")
    return re.sub("\x00(\\d+)\x00", lambda m: formulas[int(m.group(1))], s)


def clean(text: str, found: list[Leaf], formats: list[frozenset[str]], classes: np.ndarray) -> tuple[str, list[tuple[str, str]]]:
    """The text without its markup, and its blocks ``(kind, text)``.

    Leaves without markup stay as they are, blanks included. Headings and list
    items keep their lines, code its lines (without the fences) and formulas
    their notation; comments, directives, anchors and images without words go.
    """
    parts: list[str] = []
    blocks: list[tuple[str, str]] = []
    end = 0
    for leaf, marked, klass in zip(found, formats, classes):
        gap, body = text[end : leaf.start], text[leaf.start : leaf.end]
        end = leaf.end
        block = BLOCKS[int(klass)]
        if leaf.path.has("fence"):
            block, body = "code", "" if re.match(r"[ \t]*(?:```|~~~)", body) else body
        elif leaf.path.has("math", "dollars", "env:equation", "env:equation*", "env:align"):
            block, body = "formula", re.sub(r"\\(?:begin|end)\{[A-Za-z]+\*?\}", "", body)
        elif marked:
            code = block == "code"
            if "html" in marked:
                body = _plain_html(body)
            if "wiki" in marked:
                body = _plain_wiki(body)
            if "latex" in marked:
                body = _plain_latex(body)
            if "markdown" in marked and not code:
                body = _plain_markdown(body, block)
        else:
            block = "prose"
        parts += [gap, body]
        if body.strip():
            if blocks and blocks[-1][0] == block and block in ("code", "prose", "table") and not leaf.after_blank:
                joint = " " if not leaf.first else "\n"
                blocks[-1] = (block, blocks[-1][1].rstrip() + joint + body.strip("\r\n") if block == "code" else blocks[-1][1].rstrip() + joint + body.strip())
            else:
                blocks.append((block, body.strip("\r\n") if block == "code" else body.strip()))
    parts.append(text[end:])
    cleaned = "".join(parts)
    if any(formats):
        cleaned = re.sub(r"\n[ \t]*(?:\r?\n[ \t]*){2,}", "\n\n", cleaned).strip()
    return cleaned, blocks


CLEANED = "record string, formats array<string>, clean_text string, blocks array<struct<kind:string,text:string>>"


def _read(model: Labeller, threshold: float, cleaning: bool):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            rows = []
            for record, text, (found, flags, classes) in zip(batch["record"], texts, label(model, texts)):
                formats = formats_of(flags, threshold)
                cleaned, blocks = clean(text, found, formats, classes) if cleaning else (None, None)
                kinds = sorted(set().union(*formats)) if formats else []
                rows.append((record, kinds, cleaned, [{"kind": k, "text": t} for k, t in blocks] if cleaning else None))
            yield pd.DataFrame(rows, columns=["record", "formats", "clean_text", "blocks"])

    return each


def label_texts(df: DataFrame, record: str, text: str, settings: Settings = Settings(), cleaning: bool = True) -> DataFrame:
    """``record, formats, clean_text, blocks`` of every row with a text and an id.

    Texts without any sign of markup (``SIGNS``) are one block of prose and stay
    as they are: the JVM passes them through, and only the others reach the
    labeller. Null texts and ids give no row, an empty text one without blocks;
    repeated rows are labelled one by one. Without ``cleaning`` the last two
    columns are null and texts without signs give no row.
    """
    model = df.sparkSession.sparkContext.broadcast(trained(settings))
    picked = df.where(F.col(record).isNotNull() & F.col(text).isNotNull()).select(F.col(record).cast("string").alias("record"), F.col(text).alias("text"))
    signed = F.col("text").rlike(SIGNS)
    read = lambda batches: _read(model.value, settings.threshold, cleaning)(batches)
    labelled = spread(picked.where(signed)).mapInPandas(read, CLEANED)
    if not cleaning:
        return labelled
    plain = F.when(F.trim("text") != "", F.array(F.struct(F.lit("prose").alias("kind"), F.col("text").alias("text")))).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))
    return labelled.unionByName(picked.where(~signed).select("record", F.array().cast("array<string>").alias("formats"), F.col("text").alias("clean_text"), plain.alias("blocks")))
