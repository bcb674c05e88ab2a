"""Leaf sequences of marked-up text, and the vectors a block labeller reads.

A leaf is a sentence or a block element of a line, or a whole line inside code
and tables. It knows the path of structures it lies in (code fence, tables,
templates, environments, open tags) and where in its line and paragraph it stands.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# HTML element names.
TAGS = frozenset(
    "a abbr address article aside b bdi bdo big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em fieldset "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript "
    "ol option p picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th "
    "thead time title tr tt u ul var video".split()
)
VOID = frozenset("area base br col hr img input link meta source track wbr".split())

# A text without any of these has no markup: its leaves are prose.
SIGNS = r"[<>&*_#`\[\]{}|\\$~=^]|''|(?m)^[^\S\n]*(?:[-+•]|\d{1,3}[.)])\s|(?m)^[^\S\n]*-{3,}[^\S\n]*$"
_SIGN = re.compile(r"[<>&*_#`\[\]{}|\\$~=^]|''")
_LINE = re.compile(r"[^\r\n]+")
_SENTENCE = re.compile(
    r"(?<=[.!?]) +(?=[A-Z<\[{\\$*_`'\"~!|&(])| +(?=<(?:pre|table|div|p|ul|ol|h[1-6]|blockquote)\b)"
    r"|(?:(?<=</pre>)|(?<=</table>)|(?<=</div>)|(?<=</p>)|(?<=</ul>)|(?<=</ol>)|(?<=-->)|(?<=\\\])|(?<=\$\$)) +"
)
_STATE = re.compile(
    r"(?P<fence>^[ \t]*(?:```|~~~))|(?P<table>\{\|)|(?P<endtable>^\s*\|\})|(?P<template>\{\{)|(?P<endtemplate>\}\})"
    r"|\\begin\{(?P<env>[A-Za-z]+\*?)\}|\\end\{(?P<endenv>[A-Za-z]+\*?)\}|(?P<math>\\\[)|(?P<endmath>\\\])|(?P<dollars>\$\$)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?(?P<void>/?)>|(?P<comment><!--)|(?P<endcomment>-->)"
)


WORDS, MARKS, PATHS, PLACES = 24, 96, 24, 12
WIDTH = WORDS + MARKS + PATHS + PLACES


@lru_cache(maxsize=100_000)
def _slot(kind: str, token: str) -> tuple[int, float]:
    h = zlib.crc32(f"{kind} {token}".encode())
    size, base = {"word": (WORDS, 0), "mark": (MARKS, WORDS), "path": (PATHS, WORDS + MARKS)}[kind]
    return base + h % size, 1.0 if h >> 16 & 1 else -1.0


class Path:
    """An open structure, the ones it lies in, and what all of them together add to a leaf's vector.

    Paths share their outer parts, so that a leaf costs the same however deep it lies.
    """

    __slots__ = ("name", "outer", "depth", "kinds", "vector")

    def __init__(self, name: str = "", outer: Path | None = None):
        self.name, self.outer = name, outer
        self.depth = 0 if outer is None else outer.depth + 1
        self.kinds: frozenset[str] = frozenset() if outer is None else outer.kinds | {name.partition(":")[0], name}
        self.vector = np.zeros(PATHS) if outer is None else outer.vector.copy()
        if outer is not None:
            for token in (name, f"{outer.depth} {name.partition(':')[0]}"):
                slot, sign = _slot("path", token)
                self.vector[slot - WORDS - MARKS] += sign

    def has(self, *names: str) -> bool:
        """Whether a structure of one of these kinds (or a name such as ``env:align``) is open."""
        return not self.kinds.isdisjoint(names)

    def names(self) -> list[str]:
        out, at = [], self
        while at.outer is not None:
            out.append(at.name)
            at = at.outer
        return out[::-1]


@dataclass(frozen=True, slots=True)
class Leaf:
    start: int
    end: int
    path: Path
    first: bool
    last: bool
    after_blank: bool
    before_blank: bool


class _Open:
    """The stack of open structures while a text is read."""

    def __init__(self) -> None:
        self.path, self.count = Path(), Counter()

    def open(self, name: str) -> None:
        self.path = Path(name, self.path)
        self.count[name] += 1

    def close(self, name: str) -> None:
        """Close the innermost structure of the name and all within it; nothing if there is none."""
        while self.count[name]:
            inner = self.path
            self.path = inner.outer
            self.count[inner.name] -= 1
            if inner.name == name:
                return

    def read(self, line: str) -> None:
        """Open and close structures as the line says."""
        for m in _STATE.finditer(line):
            kind = m.lastgroup
            if self.path.name == "fence":
                if m["fence"]:
                    self.close("fence")
            elif m["fence"]:
                self.open("fence")
            elif m["env"]:
                self.open("env:" + m["env"])
            elif m["endenv"]:
                self.close("env:" + m["endenv"])
            elif m["tag"]:
                name = m["tag"].lower()
                if name in TAGS and name not in VOID and not m["void"]:
                    (self.close if m["close"] else self.open)("tag:" + name)
            elif kind == "dollars":
                (self.close if self.count["dollars"] else self.open)("dollars")
            elif kind and kind.startswith("end"):
                self.close(kind[3:])
            elif kind in ("table", "template", "math", "comment"):
                self.open(kind)


def leaves(text: str) -> list[Leaf]:
    out: list[Leaf] = []
    state = _Open()
    lines = [(m.start(), m.end()) for m in _LINE.finditer(text) if not m.group().isspace()]
    gaps = [True] + [text[a[1] : b[0]].count("\n") > 1 or text[a[1] : b[0]].count("\r") > 1 for a, b in zip(lines, lines[1:])] + [True]
    for k, (start, end) in enumerate(lines):
        line = text[start:end]
        before = state.path
        if _SIGN.search(line):
            state.read(line)
        # A line that closes a structure still belongs to it, one that opens some belongs to them.
        held = state.path if state.path.depth > before.depth else before
        if held.has("fence", "table") or line.lstrip().startswith("|"):
            cuts = [0, len(line)]
        else:
            # Formulas between double dollars are not cut.
            cuts = [0, *[m.end() for m in _SENTENCE.finditer(line) if line.count("$$", 0, m.start()) % 2 == 0], len(line)]
        for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append(Leaf(start + a, start + b, held, j == 0, b == len(line), gaps[k] and j == 0, gaps[k + 1] and b == len(line)))
    return out


_TOKEN = re.compile(r"</?[A-Za-z][A-Za-z0-9]*|<!--|&#?[A-Za-z0-9]+;|\\[A-Za-z]+|\\[^A-Za-z0-9\s]|[A-Za-z]+|\d+|_+|([^\w\s])\1*")


def _side(c: str) -> str:
    return "s" if not c or c.isspace() else "w" if c.isalnum() else "p"


def _mark(token: str) -> str:
    """What a sign says apart from its length, and a tag, command or entity apart from names nobody knows."""
    if token[0] == "<" and len(token) > 1 and token[1] != "!":
        name = token.lstrip("</").lower()
        return ("</" if token[1] == "/" else "<") + (name if name in TAGS else "?")
    if token[0] == "&" and len(token) > 1:
        return "&entity;"
    if token[0] == "\\" and len(token) > 1 and token[1].isalpha():
        return "\\command"
    return token[:4]


def _features(text: str, leaf: Leaf, row: int, at: list[int], values: list[float]) -> None:
    base = row * WIDTH
    body = text[leaf.start : leaf.end]
    for m in _TOKEN.finditer(body):
        token = m.group()
        if token.isalnum():
            slot, sign = _slot("word", token.lower() if token[0].isalpha() else "0")
            at.append(base + slot)
            values.append(0.25 * sign)
        elif token not in ".,;:!?":
            a, b = m.start(), m.end()
            key = _mark(token)
            around = _side(body[a - 1 : a]) + _side(body[b : b + 1])
            begins = "^" if leaf.first and not body[:a].strip() else ""
            bracket = body[b : b + 1] if key.startswith("\\command") or token in ("]", "!") else ""
            tag = ("</tag",) if key[:2] == "</" and key[2:] in TAGS else ("<tag",) if key[:1] == "<" and key[1:] in TAGS else ()
            for k in (key, f"{around[0]}{key}{around[1]}{begins}{bracket}", *tag):
                slot, sign = _slot("mark", k)
                at.append(base + slot)
                values.append(sign)
    stripped = body.strip()
    places = (
        leaf.first, leaf.last, leaf.after_blank, leaf.before_blank, stripped[:2] in ("- ", "* ", "+ "), bool(re.match(r"\d{1,3}[.)]\s", stripped)),
        stripped[-1:] in ".!?", set(stripped) <= set("-=~_* ") and len(stripped) > 2, set(stripped) <= set("|-: ") and len(stripped) > 2,
        body[:1].isspace(), len(stripped) < 40, True,
    )
    for k, value in enumerate(places):
        if value:
            at.append(base + WORDS + MARKS + PATHS + k)
            values.append(1.0)


def vectors(text: str, found: list[Leaf]) -> np.ndarray:
    """One row per leaf; a hashed sum is squeezed to its order of magnitude, so that long leaves are like short ones."""
    at: list[int] = []
    values: list[float] = []
    for row, leaf in enumerate(found):
        _features(text, leaf, row, at, values)
    x = np.bincount(at, weights=values, minlength=len(found) * WIDTH).reshape(len(found), WIDTH)
    for row, leaf in enumerate(found):
        if leaf.path.depth:
            x[row, WORDS + MARKS : WORDS + MARKS + PATHS] += leaf.path.vector
    return (np.sign(x) * np.log1p(np.abs(x))).astype(np.float32)
