"""Text cut off by field limits or broken transfers.

A stack automaton reads each text from end to end and says how it ends: what is still open
(code fences, environments, elements, brackets, quotes, inline marks), whether the last line is complete
for its kind (list item, table row, link, keyword, status or signature line),
whether the last sentence is, and whether bytes or escapes are broken. Baselines
per source say which lengths are a field's limit and whether texts of the source
are usually left without a terminator, as judged by ends that no cut would leave;
both together decide.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomry.llm.leaves import TAGS, VOID
from fathomry.session import settle, spread

# Marks of omission that never end a text by themselves, and those that may.
CUT_MARK = re.compile(r"\s*[\[(<]\s*(?:cut|truncated|trimmed|clipped|snip|snipped|more|read more|continued|cont\.?|\.\.\.|…)\s*[\])>]\s*$", re.IGNORECASE)
ELLIPSIS = re.compile(r"\s*(?:…|\.\.\.+)\s*$")
TERMINATOR = re.compile("[.!?。！？।؟]$")
CLOSERS = "\"')]}»”’*_`"
BROKEN = re.compile(r"(?:�+|\\|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|&#?[A-Za-z0-9]{1,8}|%[0-9A-Fa-f]?)$")
LONE_SURROGATE = re.compile("[\ud800-\udfff]$")
FENCE = re.compile(r"^[ \t]*(```+|~~~+)")
LIST_ITEM = re.compile(r"^\s*([-*+•]|\d+[.)])\s+(?=\S)")
BARE_MARKER = re.compile(r"^\s*(?:[-*+•>]|\d+[.)]|#{1,6}|={1,6}|\|)\s*$")
QUOTATION = re.compile(r"^\s*>+ ?")
LINK = re.compile(r"(?:https?|ftp)://[^\s/]+\.[^\s/]+(?:/\S*)?$|\]\([^()\s]+\)$|\]\]$")
FIELD = re.compile(r"^(?:\W{0,3})([A-Z][\w-]+(?: [\w-]+){0,2}): +(\S.*)$")
SIGNATURE = re.compile(r"^--? ?\S")
# A line such as "Thanks, the team", up to its comma; and the same opening a sentence anywhere else.
SIGN_OFF = re.compile(r"^([^\W\d_][\w'’-]*(?: [\w'’-]+){0,2}), \S")
OPENER = re.compile(r"(?:^|(?<=[.!?]\s))([^\W\d_][\w'’-]*(?: [\w'’-]+){0,2}), \S", re.MULTILINE)
PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
# Elements whose end tag may be left out, and structures in which nothing but their own end is markup.
OPTIONAL_END = frozenset("p li dt dd tr td th thead tbody tfoot colgroup option html head body".split())
RAW = frozenset(("tag:pre", "tag:code", "tag:script", "tag:style", "env:verbatim", "env:lstlisting"))
SIGNS = re.compile(r"[`~<\\(\[{“«\"*$]")
STRUCTURE = re.compile(
    r"(?=[\n\t `~<\\()\[\]{}“”«»\"*$:;'-])(?:(?P<blank>\n[ \t]*(?=\n))|(?P<fence>^[ \t]*(?:```+|~~~+))|(?P<comment><!--)|(?P<endcomment>-->)"
    r"|\\(?P<env>begin|end)\{(?P<name>[A-Za-z]+\*?)\}|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*?)?(?P<void>/?)>"
    r"|(?P<none>['\"`][()\[\]{}]['\"`]|[\[(]\s*[-+\w.∞]+\s*,\s*[-+\w.∞]+\s*[\])]|[:;]-?[()\[\]])|(?P<code>`+)|(?P<mark>\*\*|~~|\$\$)"
    r"|(?P<open>[(\[{“«])|(?P<shut>[)\]}”»])|(?P<quote>\"))",
    re.MULTILINE,
)
# A text that ends inside a tag.
TAG_END = re.compile(r"(?:^|[\s>])<(?:/?[A-Za-z][A-Za-z0-9]*(?:\s+[\w-]+(?:\s*=\s*(?:\"[^\"<>]*\"?|'[^'<>]*'?|[^\s\"'<>]*))?)*\s*/?|!-*)$")
# What ends a structure: end tags at the end of a line, and ends that stand on their own line.
END_TAGS = re.compile(r"(?:\s*(?:</[A-Za-z][A-Za-z0-9]*\s*>|-->))+$")
OWN_END = re.compile(r"^\s*(?:\\end\{[A-Za-z]+\*?\}|\|\}|\}\}|\$\$|\\\])$")
MAX_SIGN_OFF_WORDS = 6
MAX_FIELD_WORDS = 6
SHORT_REMARK_WORDS = 6
SENTENCE_WORDS = 5
# Words that need another one after them, in the languages found. Words that may end a note ("log in", "shut down") are left out.
FUNCTION_WORDS = frozenset(
    "a an the of and or but nor if than because whether while although unless since from with to into onto at by for as is are was were be been has have had its their our your my his "
    "which whose that when where who not no every each both between during without "
    "der die das den dem des ein eine einen einem einer und oder aber weil dass ob wenn von vom zum zur im am für mit bei nach ist sind war waren wird wurde wurden muss hat haben sein seine ihr ihre nicht "
    "le la les l d un une du de et ou mais que qui si dans sur pour avec par au aux est sont a été était doit son sa ses leur ce cette ces ne pas "
    "el los las unos unas y o pero porque con por para en al es son fue fueron su sus del se hay ha han "
    "il lo gli uno e ma che di da nel della".split()
)
DANGLING = (",", ";", ":", "-", "–", "—", "(", "[", "/", "&", "+", "=")
LAST_WORD = re.compile(r"[^\W\d_][^\W_]*$")
# Of cuts of prose, wherever they fall, at least this share ends inside a word, after a function word or after a comma: random ones in two of three cases inside a word.
SHOWN = 1 / 3
# About the longest word with its blank: so far below its limit a text may end that was cut between words.
BAND = 12


class _Stack:
    """Open structures, innermost last, with their numbers by name."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.count: Counter = Counter()

    def push(self, name: str) -> None:
        self.names.append(name)
        self.count[name] += 1

    def close(self, name: str) -> None:
        """Close the innermost one of the name with all it holds; an end without a beginning is only a sign."""
        while self.count[name]:
            last = self.names.pop()
            self.count[last] -= 1
            if last == name:
                return

    def toggle(self, name: str, opens: bool, closes: bool) -> None:
        if self.count[name] and closes:
            self.close(name)
        elif not self.count[name] and opens:
            self.push(name)

    def forget_inline(self) -> None:
        """Inline marks do not reach beyond their paragraph: left open there, they were only signs."""
        if any(self.count[m] for m in ("**", "~~")) or any(n[0] == "`" for n in self.names):
            self.names = [n for n in self.names if n not in ("**", "~~") and n[0] != "`"]
            self.count = Counter(self.names)


def open_structures(text: str) -> list[str]:
    """What a pushdown automaton has on its stack at the end of the whole text.

    Code fences, environments, comments and elements (with an end tag that may
    not be left out) nest and hold across paragraphs, as do brackets and
    quotations; double stars, tildes and code spans end with their paragraph. Inside
    fences, comments and verbatim structures only their own end counts.
    Smileys, intervals, brackets in quotes, ends without a beginning and quote
    signs that stand at no word's beginning are only signs.
    """
    if not SIGNS.search(text):
        return []
    stack = _Stack()
    for m in STRUCTURE.finditer(text):
        top, kind = stack.names[-1] if stack.names else "", m.lastgroup
        if top[:5] == "fence":
            if m["fence"] and m["fence"].strip()[0] == top[6]:
                stack.close(top)
        elif top == "<!--":
            if kind == "endcomment":
                stack.close(top)
        elif m["tag"]:
            name = m["tag"].lower()
            if name in TAGS and name not in VOID and name not in OPTIONAL_END and not m["void"]:
                if m["close"]:
                    stack.close("tag:" + name)
                elif top not in RAW:
                    stack.push("tag:" + name)
        elif m["env"] == "end":
            stack.close("env:" + m["name"])
        elif top in RAW or m["none"]:
            continue
        elif m["env"]:
            stack.push("env:" + m["name"])
        elif m["fence"]:
            stack.push("fence " + m["fence"].strip()[0])
        elif kind == "comment":
            stack.push("<!--")
        elif kind == "blank":
            stack.forget_inline()
        elif m["code"]:
            stack.toggle(m["code"], True, True)
        elif top[:1] == "`":
            continue
        else:
            before, after = text[m.start() - 1 : m.start()] if m.start() else "", text[m.end() : m.end() + 1]
            if m["mark"]:
                display = m["mark"] == "$$"
                stack.toggle(m["mark"], display or bool(after) and not after.isspace(), display or not before.isspace())
            elif m["open"]:
                stack.push(m["open"])
            elif m["shut"]:
                stack.close(PAIRS[m["shut"]])
            elif m["quote"]:
                stack.toggle('"', bool(after) and not after.isspace() and (not before or before.isspace() or before in "([{“«<>=*_-—/"), not before.isspace() or not after.strip())
    return stack.names + (["<"] if TAG_END.search(text[-2000:]) else [])


def _is_sentence_item(lines: list[str]) -> bool:
    """Whether the last line's list has sentences for items, going by the items right before it, or else by its own form."""
    marker = LIST_ITEM.match(lines[-1]).group(1)
    before = []
    for line in reversed(lines[:-1]):
        m = LIST_ITEM.match(line)
        if not m or m.group(1)[-1] != marker[-1]:
            break
        before.append(bool(TERMINATOR.search(line.rstrip().rstrip(CLOSERS))))
    if before:
        return 2 * sum(before) > len(before)
    words = lines[-1].split()[1:]
    return words[0][:1].isupper() and len(words) >= SENTENCE_WORDS


def ending(text: str | None) -> tuple[str, bool, bool]:
    """``(kind, marked, broken)`` of a text's end.

    ``kind``: ``complete`` (a terminator, or a line complete for its kind),
    ``bare`` (prose without a terminator), ``open`` (something unclosed),
    ``remark`` (a short line of its own that ends in an ellipsis) or ``empty``.
    ``marked``: a mark of omission follows, and the kind is that of what stands
    before it. ``broken``: the last character or escape is cut in two.
    """
    if text is None or not text.strip():
        return "empty", False, False
    body = text.rstrip()
    bare = CUT_MARK.sub("", body)
    marked = bare != body
    soft = False
    if not marked and ELLIPSIS.search(body):
        bare, soft = ELLIPSIS.sub("", body), True
    broken = bool(LONE_SURROGATE.search(bare)) or (bool(BROKEN.search(bare)) and not bare.endswith("\\\\") and not re.search(r"\d%$|\s&$", bare))
    line = bare.rsplit("\n", 1)[-1]
    # What is open decides, however complete the last line looks.
    if open_structures(bare):
        return "open", marked or soft, broken
    if soft:
        if len(line.split()) <= SHORT_REMARK_WORDS and line[:1].isupper() and "." not in line:
            return "remark", False, broken
        marked = True
    if FENCE.match(line) or OWN_END.match(line) or not END_TAGS.sub("", line).strip():
        return "complete", marked, broken
    if BARE_MARKER.match(line) and not re.match(r"^\s*[=|]", line):
        return "open", marked, broken
    stripped = END_TAGS.sub("", line).rstrip(CLOSERS)
    if line.lstrip().startswith("|"):
        return ("complete" if line.endswith("|") and line.count("|") > 1 else "open"), marked, broken
    heading = re.match(r"^(={2,6})(.*)$", line)
    if heading:
        return ("complete" if line.endswith(heading.group(1)) and len(line) > 2 * len(heading.group(1)) else "open"), marked, broken
    if TERMINATOR.search(stripped) and not re.match(r"^\s*\d+\.$", stripped):
        return "complete", marked, broken
    if LINK.search(line):
        return "complete", marked, broken
    if re.match(r"^#{1,6} ", line) or QUOTATION.match(line) or line.endswith((",", ";", ":", "-", "–")):
        return "bare", marked, broken
    if LIST_ITEM.match(line):
        return ("bare" if _is_sentence_item(bare.split("\n")) else "complete"), marked, broken
    field = FIELD.match(line)
    if field and len(field.group(1)) > 1 and len(field.group(2).split()) <= MAX_FIELD_WORDS:
        return "complete", marked, broken
    if SIGNATURE.match(line) and len(line.split()) <= MAX_SIGN_OFF_WORDS and "\n" in bare or sign_off(bare):
        return "complete", marked, broken
    return "bare", marked, broken


def sign_off(body: str) -> str | None:
    """The opening word of a last line that has the form of a sign-off.

    Such a line is short, stands alone after a finished line and begins with
    one to three words and a comma. Sentences begin so too: how a line's opening
    is used in all texts tells the two apart (``sign_offs``).
    """
    head, _, line = body.rpartition("\n")
    found = SIGN_OFF.match(line)
    if not found or len(line.split()) > MAX_SIGN_OFF_WORDS or not line[0].isupper() or not TERMINATOR.search(head.rstrip().rstrip(CLOSERS)):
        return None
    return opening(found.group(1))


def opening(words: str) -> str:
    """The first word, in lower case."""
    return words.split(" ", 1)[0].lower()


ENDINGS = "record long, source string, kind string, marked boolean, broken boolean, sentence boolean, chars int, bytes int, dangling boolean, last string, closing string, openers array<string>"


def dangling(text: str) -> tuple[bool, str | None]:
    """Whether an end asks for another word, and the last word in lower case if the text ends with its last letter."""
    body = text.rstrip()
    word = LAST_WORD.search(body[-200:])
    last = word.group().lower() if word else None
    return body.endswith(DANGLING) or last in FUNCTION_WORDS, last


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for record, source, text in zip(batch["record"], batch["source"], batch["text"]):
            kind, marked, broken = ending(text)
            body = (text or "").rstrip()
            sentence = bool(TERMINATOR.search(body.rstrip(CLOSERS)))
            hangs, last = dangling(text) if kind == "bare" and not marked else (kind in ("complete", "remark") and not marked and text.split()[-1].lower() in FUNCTION_WORDS, None)
            closing = sign_off(body) if kind == "complete" and not sentence else None
            openers = sorted({opening(x) for x in OPENER.findall(body[: body.rfind("\n") + 1] if closing else body)})
            rows.append((record, source, kind, marked, broken, sentence, len(text or ""), len((text or "").encode("utf-8", "surrogatepass")), hangs, last, closing, openers))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENDINGS.split(", ")])


def endings(df: DataFrame, record: str, text: str, source: str) -> DataFrame:
    """One row per record with a non-null id: how its whole text ends (``ENDINGS``)."""
    picked = df.where(F.col(record).isNotNull()).select(F.col(record).cast("long").alias("record"), F.col(source).alias("source"), F.col(text).alias("text"))
    return spread(picked).mapInPandas(_read, ENDINGS)


def source_baselines(ends: DataFrame, least: int = 3, share: float = 0.02) -> DataFrame:
    """Per source: ``char_limit, byte_limit`` (null where there is none).

    A limit is the greatest length found, if at least ``least`` texts and
    ``share`` of the source's texts have exactly that length and most of these do not end a sentence.
    """
    def limit(length: str) -> DataFrame:
        counts = ends.groupBy("source", F.col(length).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("sentence")).alias("cut"))
        facts = counts.groupBy("source").agg(F.max(F.struct("size", "n", "cut")).alias("top"), F.sum("n").alias("all"))
        real = (F.col("top.n") >= least) & (F.col("top.n") >= share * F.col("all")) & (2 * F.col("top.cut") > F.col("top.n"))
        return facts.select("source", F.when(real, F.col("top.size")).alias(f"{length}_limit"))

    chars, octets = limit("chars").alias("c"), limit("bytes").alias("b")
    both = chars.join(octets, F.col("c.source").eqNullSafe(F.col("b.source")))
    return both.select(F.col("c.source").alias("source"), F.col("chars_limit").alias("char_limit"), F.col("bytes_limit").alias("byte_limit"))


def limit_bands(ends: DataFrame, length: str, least: int = 3, share: float = 0.02) -> DataFrame:
    """Per source: ``bands``, the ranges (``low``, ``high``) of lengths right below a limit, anywhere among its lengths.

    A band is one word wide. In it at least ``least`` texts and ``share`` of the source's texts end
    no sentence, which are most of its texts and more than twice as many as in the two bands on either side
    together; and a fifth of them show a cut (something open or broken, a function word, a comma), so
    that notes or repeated texts of much the same length make no limit.
    """
    shows = F.col("broken") | F.col("dangling") | (F.col("kind") == "open")
    counts = ends.where(F.col("kind") != "empty").groupBy("source", F.col(length).alias("high")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("sentence")).alias("cut"), F.count_if(~F.col("sentence") & shows).alias("shown")
    )
    order = W.partitionBy("source").orderBy("high")
    within = lambda c, a, b: F.coalesce(F.sum(c).over(order.rangeBetween(a, b)), F.lit(0))
    facts = counts.select(
        "source", "high", F.col("cut").alias("here"), within("n", 1 - BAND, 0).alias("n"), within("cut", 1 - BAND, 0).alias("cut"), within("shown", 1 - BAND, 0).alias("shown"),
        (within("cut", 1 - 3 * BAND, -BAND) + within("cut", 1, 2 * BAND)).alias("beside"), F.sum("n").over(W.partitionBy("source")).alias("all"),
    )
    real = (F.col("here") > 0) & (F.col("cut") >= least) & (F.col("cut") >= share * F.col("all")) & (2 * F.col("cut") > F.col("n")) & (F.col("cut") > 2 * F.col("beside")) & (5 * F.col("shown") >= F.col("cut"))
    return facts.where(real).groupBy("source").agg(F.collect_list(F.struct((F.col("high") - BAND + 1).alias("low"), "high")).alias("bands"))


def at_limits(ends: DataFrame) -> DataFrame:
    """``ends`` with ``exact``, whether a text is as long as its source allows, and ``at_limit``, whether it is that or at most a word shorter."""
    base = source_baselines(ends)
    for length in ("chars", "bytes"):
        bands = limit_bands(ends, length).select(F.col("source").alias("__source"), F.col("bands").alias(f"{length}_bands"))
        base = base.join(bands, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    base = base.alias("s")
    joined = ends.alias("e").join(base, F.col("e.source").eqNullSafe(F.col("s.source")), "left")
    # A limit in bytes stops short of a character that would not fit.
    wide = F.col("bytes").between(F.col("byte_limit") - 2, F.col("byte_limit")) & (F.col("bytes") > F.col("chars"))
    exact = F.coalesce((F.col("chars") == F.col("char_limit")) | (F.col("bytes") == F.col("byte_limit")) | wide, F.lit(False))
    inside = lambda length: F.exists(f"{length}_bands", lambda band: F.col(length).between(band["low"], band["high"]))
    at_limit = exact | F.coalesce(inside("chars"), F.lit(False)) | F.coalesce(inside("bytes"), F.lit(False))
    return joined.select("e.*", exact.alias("exact"), at_limit.alias("at_limit"))


def sign_offs(ends: DataFrame) -> DataFrame:
    """``closing``: openings of last lines that more texts end with than begin a sentence or line with elsewhere.

    Counts cover all texts; openings are merged where texts are read.
    """
    used = ends.select(F.explode(F.concat(F.array_compact(F.array(F.when(F.col("closing").isNotNull(), F.struct("closing", F.lit(1).alias("n"))))), F.transform("openers", lambda o: F.struct(o.alias("closing"), F.lit(-1).alias("n"))))).alias("x"))
    return used.groupBy(F.col("x.closing").alias("closing")).agg(F.sum("x.n").alias("more")).where(F.col("more") > 0).select("closing")


def word_parts(ends: DataFrame, texts: DataFrame) -> DataFrame:
    """``last``: the last words of ``ends`` that no text of ``texts`` has inside, while a longer word inside a text begins with them."""
    # Marks of omission go first: the word before them may be cut itself.
    body = F.regexp_replace(F.regexp_replace("text", r"\s+$", ""), "(?i)(?:" + CUT_MARK.pattern + "|" + ELLIPSIS.pattern + ")", "")
    words = F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(r"(\p{L}[\p{L}\p{N}]*)(?=[^\p{L}\p{N}])"), F.lit(1)))
    inside = settle(texts.select(F.explode(words).alias("word")).distinct())
    asked = ends.where(F.col("last").isNotNull()).select("last").distinct()
    unknown = asked.join(inside, F.col("last") == F.col("word"), "left_anti")
    begins = inside.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.substring("word", F.lit(1), n))).alias("begin")).distinct()
    return unknown.join(begins, F.col("last") == F.col("begin"), "left_semi")


def terse_sources(ends: DataFrame, most: float = 0.6) -> DataFrame:
    """Sources (``source``) that leave more than ``most`` of their texts without a terminator, cuts apart.

    Of texts below the limit with no other sign of a cut, bare ends at a whole
    word that asks for no other are the habit's. But cuts leave such ends too:
    they are taken to be as many as the ends that only a cut leaves
    (``dangling``) allow at most, going by ``SHOWN`` and two standard errors.
    So a few texts are no evidence of a habit, and a source of cuts has none.
    """
    below = ends.where(~F.col("at_limit") & ~F.col("broken") & ~F.col("marked") & F.col("kind").isin("bare", "complete", "remark"))
    facts = below.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "bare").alias("bare"), F.count_if((F.col("kind") == "bare") & F.col("dangling")).alias("shown"))
    cuts = F.least(F.col("bare").cast("double"), (F.col("shown") + 2 + 2 * F.sqrt(F.col("shown") + F.lit(1.0))) / SHOWN)
    return facts.where(F.col("bare") - cuts > most * (F.col("n") - cuts)).select("source")


def truncated(df: DataFrame, record: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``record, source, truncated, reason, at_limit`` of every record.

    ``reason``: ``broken`` character or escape, ``open`` structure, omission
    ``mark`` after an unfinished sentence, ``bare`` end of prose, or ``limit``
    (a line that could be complete, but the text is exactly as long as its
    source allows and ends no sentence, or at most a word shorter and ends at a function word). Null, empty and blank texts are not
    truncated; a null source is a source of its own; rows with a null id are
    ignored, and repeated rows are judged one by one. In a source whose texts
    below its limit mostly end without terminators (``terse_sources``), a bare end below the
    limit says nothing unless it is inside a word, at a function word or at a comma.
    """
    read = settle(endings(df, record, text, source))
    # A last line that only looks like a sign-off is the beginning of a sentence.
    closed = read.where(F.col("closing").isNotNull()).join(sign_offs(read).withColumn("signed", F.lit(True)), "closing", "left")
    judged = closed.withColumn("kind", F.when(F.col("signed").isNull(), "bare").otherwise(F.col("kind"))).drop("openers", "signed")
    ends = settle(at_limits(read.where(F.col("closing").isNull()).drop("openers").unionByName(judged).drop("closing")))
    # Parts of words only make a source less terse: they are looked up where it could be.
    could = terse_sources(ends)
    if could.isEmpty():
        judged = ends.withColumn("terse", F.lit(False))
    else:
        same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
        asked = ends.alias("e").join(could.alias("t"), same("e", "t"), "left_semi")
        parts = word_parts(asked, df.where(F.col(record).isNotNull()).select(F.col(text).alias("text"))).withColumn("part", F.lit(True))
        marked = settle(ends.join(parts, "last", "left").withColumn("dangling", F.col("dangling") | F.coalesce("part", F.lit(False))))
        terse = terse_sources(marked).withColumn("terse", F.lit(True))
        judged = marked.alias("e").join(terse.alias("t"), same("e", "t"), "left").select("e.*", F.coalesce("terse", F.lit(False)).alias("terse"))
    reason = (
        F.when(F.col("kind") == "empty", None)
        .when(F.col("broken"), "broken")
        .when(F.col("kind") == "open", "open")
        .when(F.col("marked") & (F.col("kind") == "bare"), "mark")
        .when((F.col("kind") == "bare") & (~F.col("terse") | F.col("dangling") | F.col("at_limit")), "bare")
        .when(F.col("kind").isin("complete", "remark") & (F.col("exact") | F.col("at_limit") & F.col("dangling")) & ~F.col("sentence"), "limit")
    )
    return judged.select("record", "source", reason.isNotNull().alias("truncated"), reason.alias("reason"), "at_limit")


def truncation_report(judged: DataFrame) -> DataFrame:
    """Per source: texts, truncated texts by reason, and the rate."""
    count = lambda name: F.count_if(F.coalesce(F.col("reason") == name, F.lit(False))).alias(f"n_{name}")
    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if("truncated").alias("n_truncated"), *[count(r) for r in ("broken", "open", "mark", "bare", "limit")],
        F.round(F.count_if("truncated") / F.count(F.lit(1)), 6).alias("rate"),
    )
