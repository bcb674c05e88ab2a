"""Labelled texts for the block labeller, made from a grammar of markup and look-alikes.

Each sample is a text with labelled spans: which markup formats a span holds and
what kind of block it is. Words are made up, so that the labeller learns signs
and places instead of a vocabulary.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

FORMATS = ("html", "markdown", "wiki", "latex")
BLOCKS = ("prose", "heading", "list", "table", "code", "formula", "quote", "residue")

_COMMON = "the a of and to in is was for with that on as are by this from be or an it not have but were which when their one all can more if has after new other".split()
_ONSETS = "b c d f g h j k l m n p r s t v w br cl dr fl gr pl pr sh sl st tr".split()
_RIMES = "a e i o u an ar el en er il in or un est ock ine age ode ath".split()


@dataclass
class Sample:
    text: str = ""
    spans: list[tuple[int, int, frozenset, str]] = field(default_factory=list)

    def add(self, text: str, formats: set | frozenset = frozenset(), block: str = "prose") -> None:
        self.spans.append((len(self.text), len(self.text) + len(text), frozenset(formats), block))
        self.text += text


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        return r.choice(_COMMON) if r.random() < 0.4 else "".join(r.choice(_ONSETS) + r.choice(_RIMES) for _ in range(r.randint(1, 3)))

    def name(self) -> str:
        return "".join(self.r.choice(_ONSETS) + self.r.choice(_RIMES) for _ in range(self.r.randint(1, 3)))

    def phrase(self, low: int = 1, high: int = 3) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def number(self) -> str:
        return str(self.r.choice([self.r.randint(0, 9), self.r.randint(10, 99), self.r.randint(100, 9999)]))

    def sentence(self) -> str:
        words = [self.word() for _ in range(self.r.randint(4, 16))]
        if self.r.random() < 0.2:
            words[self.r.randrange(len(words))] = self.number()
        if self.r.random() < 0.15:
            words.insert(2, words.pop() + ",")
        if self.r.random() < 0.06:
            words[-1] = f'"{words[-1]}"'
        if self.r.random() < 0.05:
            words[1] = f"({words[1]})"
        if self.r.random() < 0.05:
            words[1] += self.r.choice(["'s", "-" + self.name(), "'t"])
        text = " ".join(words)
        return text[0].upper() + text[1:] + self.r.choice("...?!")

    def lookalike(self) -> str:
        """Plain prose with signs that are no markup."""
        r, w, n = self.r, self.name, self.number
        return r.choice(
            [
                lambda: f"The {w()} holds while {w()[0]} < {w()[0]} and {w()[0]} > {n()} for the {w()}.",
                lambda: f"The field is a {w().title()}<{w().title()}> and the {w()} is a {w().title()}Map<u{n()}, {w().title()}>.",
                lambda: f"We tried {n()} * {n()} * {n()} {w()} rows.",
                lambda: f"Set {w()}_{w()}_size and {w()}_{w()} in the {w()}.",
                lambda: f"Set use_{w().upper()} before you {w()} the {w()}.",
                lambda: f"It costs ${n()} a month, or ${n()} a {w()}.",
                lambda: f"The {w()} costs ${n()}.{n()}, not ${n()}.",
                lambda: f"On that host the path is C:\\{w()}\\{w()}\\{w()}.",
                lambda: f"Look in D:\\{w()}\\{w()}.txt or \\\\{w()}\\{w()}.",
                lambda: f"The {w().upper()[0]}&{w().upper()[0]} group owns the {w()}; {w()} & {w()} do not.",
                lambda: f"Pipe {w()[0]} | {w()[0]} works - {w()} - on the {w()}.",
                lambda: f"Run {w()} | {w()} -n {n()} > {w()}.txt first.",
                lambda: f"Issue #{n()} covers {w()}[{n()}] and the {w()}, see [{n()}].",
                lambda: f"The {w()} was #{n()} in {w().title()}, and #{w()} was next.",
                lambda: f"Type {w()[0]}/{w()[0]} == {w()}, then {w()} >= 0.{n()} && {w()}.",
                lambda: f"It prints {{{w()}: {w()}}} in ~{n()} ms (was {n()} ms).",
                lambda: f"Expect {n()} -> {n()} rows; {n()}% are {w()} <{n()}.",
                lambda: f"Use {w()}({w()}, {n()}) when {w()} != {w()} or x^{n()} = {n()}.",
                lambda: f"The call {w()}.{w()}(x) gives [{n()}, {n()}] or {{}} if {w()} ~= {w()}.",
                lambda: f"The {w()}'s {w()} isn't {w()}'s 'own' {w()}.",
                lambda: f"Send it to {w()}@{w()}.org or http://{w()}.org/{w()}_{w()}?a={n()}&b={n()} today.",
                lambda: f"{w().title()} - {w()} - is a {w()}; see {w()} -- or {w()}.",
                lambda: f"Open the {w()}, look for ({w().title()}{n()}{w()}), then {w()} it.",
                lambda: f"The {w()} is {n()}*{n()} = {n()} and {w()}* is a wildcard.",
                lambda: f"We love it <3 and it is >{n()} or <={n()}.",
            ]
        )()

    def code_line(self) -> str:
        r, w, n = self.r, self.name, self.number
        return r.choice(
            [
                lambda: f"{w()} = {w()}({w()}, {n()})  # {w()} {w()}",
                lambda: f"{w()}: {n()}",
                lambda: f"{w()} --{w()} {w()} --dry-{w()}",
                lambda: f"    return {w()}[{n()}] if {w()} < {n()} else {w()}",
                lambda: f"if ({w()} && {w()}) {{ {w()}(); }}",
                lambda: f'{{"{w()}": "{w()}", "{w()}": {n()}}}',
                lambda: f"$ {w()} | {w()} > {w()}.log",
                lambda: f"for {w()} in {w()}:",
                lambda: f"SELECT {w()}, {w()} FROM {w()} WHERE {w()} = {n()};",
                lambda: f"{w()} {w()}",
            ]
        )()

    def formula(self) -> str:
        r, w, n = self.r, self.name, self.number
        v = lambda: r.choice("abcdnmkxyzuvw")
        return r.choice(
            [
                lambda: f"\\{r.choice(['alpha', 'beta', 'lambda'])} {v()}_{v()} + (1-\\alpha) {v()}_{v()}",
                lambda: f"\\sum_{{{v()}=1}}^{{{v()}}} {v()}_{v()} {v()}_{v()} \\le {n()}",
                lambda: f"{v()}({v()},{v()}) = 1 - \\frac{{{v()} \\cdot {v()}}}{{\\|{v()}\\| \\|{v()}\\|}}",
                lambda: f"{v()} = \\sqrt{{{v()}^2 + {v()}^2}}",
                lambda: f"O(\\log {v()})",
                lambda: f"\\{r.choice(['theta', 'mu', 'sigma'])} = 0.{n()}",
                lambda: f"{v()}^2 + {v()}_{{{w()}}} = {n()}",
                lambda: f"\\int_0^1 {v()}({v()})\\,d{v()}",
            ]
        )()

    def marked_phrase(self, name: str) -> str:
        """A phrase in one of a format's inline forms."""
        r, w, p, n = self.r, self.name, self.phrase(1, 3), self.number
        tag = r.choice(["b", "i", "u", "em", "strong", "code", "kbd", "sub", "sup", "span", "small", "tt", "q", "font", "mark", "a"])
        forms = {
            "html": [f"<{tag}>{p}</{tag}>", f"<{tag} class=\"{w()}\">{p}</{tag}>", f"{p}&nbsp;{w()}", f"{w()} &amp; {w()}", f"{p}<br>", f"&lt;{w()}&gt;"],
            "markdown": [f"**{p}**", f"*{p}*", f"_{p}_", f"__{p}__", f"`{p}`", f"~~{p}~~", f"[{p}]({w()}/{w()}.md)", f"{p}[^{n()}]", f"![{p}]({w()}.png)"],
            "wiki": [f"[[{p}]]", f"[[{w()}|{p}]]", f"''{p}''", f"'''{p}'''", "{{" + f"{w()}|{p}" + "}}"],
            "latex": [f"\\emph{{{p}}}", f"\\textbf{{{p}}}", f"\\cite{{{w()}}}", f"\\texttt{{{p}}}", f"${self.formula()}$", f"\\({self.formula()}\\)", f"{w()}~\\ref{{{w()}}}", f"\\url{{{w()}}}"],
        }
        return r.choice(forms[name])

    def inline(self, name: str, s: Sample) -> None:
        """A sentence with one marked phrase anywhere in it."""
        words = self.sentence()[:-1].split()
        at = self.r.randint(0, len(words))
        words[at:at] = [self.marked_phrase(name)]
        s.add(" ".join(words[self.r.randint(0, at) :]) + self.r.choice("...?!") + " ", {name})

    # One method per format: adds one construct to the sample, inline (to the running paragraph) or as lines of its own.

    def html(self, s: Sample) -> None:
        r, w, p, n = self.r, self.name, self.phrase, self.number
        k = {"html"}
        tag = lambda t: t.upper() if r.random() < 0.15 else t
        choice = r.randrange(14)
        if choice == 0:
            t = r.choice(["b", "em", "strong", "i", "u", "code", "kbd", "mark", "small", "del"])
            s.add(f"The {w()} is <{t}>{p()}</{t}> and <em>{w()}</em> {w()}. ", k)
        elif choice == 1:
            s.add("\n\n")
            s.add(f"<div class=\"{w()}-{w()}\">" + self.sentence(), k)
            for _ in range(r.randint(0, 2)):
                s.add(" " + self.sentence(), k if r.random() < 0.0 else set())
            s.add(r.choice(["\n", ""]) + "</div>", k, "residue")
            s.add("\n\n")
        elif choice == 2:
            s.add(f"<p>{self.sentence()}</p>\n", k)
        elif choice == 3:
            s.add(f"{self.sentence()}<br/>{self.sentence()}{r.choice(['<br>', '<br />', '<hr/>'])} ", k)
        elif choice == 4:
            s.add(f"\n<{tag('ul')}>\n", k, "list")
            for _ in range(r.randint(1, 4)):
                s.add(f"<{tag('li')}>{p()}" + r.choice(["", "</li>"]) + "\n", k, "list")
            s.add(f"</{tag('ul')}>\n", k, "list")
        elif choice == 5:
            s.add(f"<a href=\"/{w()}/{w()}.html\" class=\"{w()}\">{p()}</a> ", k)
        elif choice == 6:
            s.add(f"<span style=\"color:#{n()}\">{w()}</span> {w()} x<sup>{n()}</sup> ", k)
        elif choice == 7:
            s.add(f"<table><tr><th>{w()}</th><td>{n()}</td></tr></table>\n", k, "table")
        elif choice == 8:
            s.add(f"\n<pre><code>{self.code_line()}</code></pre>\n", k, "code")
        elif choice == 9:
            s.add(f"&lt;{w()}&gt; is {w()} by &quot;{w()}&quot;. ", k)
        elif choice == 10:
            s.add(f"The {w()}&nbsp;&amp;&nbsp;{w()} pair isn&#{r.choice(['8217', 'x27', '39'])};t {w()}. ", k)
        elif choice == 11:
            s.add(f"<!-- {p(1, 5)} -->", k, "residue")
            s.add("\n")
        elif choice == 12:
            d = r.randint(1, 6)
            q = r.choice("'\"")
            s.add(f"\n<h{d} id={q}{w()}{q}>{p().title()}</h{d}>", k, "heading")
            s.add(r.choice([" ", "\n"]) + self.sentence() + "\n")
        else:
            s.add(f"<img src=\"{w()}.png\" alt=\"{p()}\"/> ", k)

    def markdown(self, s: Sample) -> None:
        r, w, p, n = self.r, self.name, self.phrase, self.number
        k = {"markdown"}
        choice = r.randrange(17)
        if choice == 0:
            s.add("\n\n")
            s.add("#" * r.randint(1, 6) + f" {p(1, 5).capitalize()}" + (" " + self.marked_phrase("markdown") if r.random() < 0.2 else "") + "\n", k, "heading")
            s.add("\n")
        elif choice == 1:
            s.add("\n\n")
            s.add(f"{p(1, 3).capitalize()}\n{r.choice('-=') * r.randint(3, 12)}\n", k, "heading")
            s.add("\n")
        elif choice == 2:
            s.add("\n")
            mark = r.choice(["- ", "- ", "* ", "+ "])
            for _ in range(r.randint(1, 6)):
                s.add(f"{mark}{p(1, 7)}" + (" " + self.marked_phrase("markdown") if r.random() < 0.15 else "") + "\n", k, "list")
            s.add("\n")
        elif choice == 3:
            s.add("\n")
            for i in range(1, r.randint(2, 6)):
                s.add(f"{i}{r.choice('..)')} {p(1, 7)}\n", k, "list")
            s.add("\n")
        elif choice == 4:
            s.add("\n")
            for _ in range(r.randint(1, 3)):
                s.add(f"- [{r.choice(' xX')}] {p(1, 5)}\n", k, "list")
        elif choice == 5:
            fence = r.choice(["```", "```", "~~~"])
            s.add("\n\n")
            s.add(f"{fence}{r.choice(['', 'python', 'sh', 'json', 'rust', 'yaml'])}\n" + "".join(self.code_line() + "\n" for _ in range(r.randint(1, 8))) + f"{fence}\n", k, "code")
            s.add("\n")
        elif choice == 6:
            s.add(f"Run `{w()} {w()}` when the {w()} is {w()}. ", k)
        elif choice == 7:
            s.add(f"This is *{p()}* {w()} by the _{p()}_ {w()}. ", k)
        elif choice == 8:
            s.add(f"Remember that the **{p()}** is __{p()}__ {w()}. ", k)
        elif choice == 9:
            s.add(f"The ~~{w()}~~ {w()} {w()} wins. ", k)
        elif choice == 10:
            s.add(f"See [the {p()}]({r.choice(['../', 'http://', '/'])}{w()}/{w()}.md) for the {w()}. ", k)
        elif choice == 11:
            s.add(f"![{p()}](img/{w()}.png)", k)
            s.add(r.choice([" ", "\n"]))
        elif choice == 12:
            s.add(f"The {w()} is described elsewhere.[^{n()}] ", k)
        elif choice == 13:
            s.add("\n")
            for _ in range(r.randint(1, 3)):
                s.add(f"> {self.sentence()}\n", k, "quote")
            s.add("\n")
        elif choice == 14:
            columns = r.randint(2, 4)
            row = lambda cells: "| " + " | ".join(cells) + " |\n"
            s.add("\n")
            s.add(row([p(1, 2) for _ in range(columns)]) + "|" + "|".join(r.choice(["---", "---:", ":--:"]) for _ in range(columns)) + "|\n", k, "table")
            for _ in range(r.randint(1, 6)):
                s.add(row([r.choice([p(1, 2), n()]) for _ in range(columns)]), k, "table")
            s.add("\n")
        elif choice == 15:
            s.add(f"[{w()}]: http://{w()}.org/{w()}\n", k, "residue")
        else:
            s.add(f"See <http://{w()}.org/{w()}> and **{w()}**. ", k)

    def wiki(self, s: Sample) -> None:
        r, w, p, n = self.r, self.name, self.phrase, self.number
        k = {"wiki"}
        choice = r.randrange(13)
        if choice == 0:
            d = "=" * r.randint(2, 4)
            s.add("\n")
            s.add(f"{d} {p(1, 4).capitalize()} {d}\n", k, "heading")
        elif choice == 1:
            s.add(f"The [[{w()}]] and the [[{p(2, 3)}]] are {w()}. ", k)
        elif choice == 2:
            s.add(f"See [[{p(1, 2).capitalize()}|the {w()} page]] for the {w()}. ", k)
        elif choice == 3:
            s.add(f"[[{r.choice(['File', 'Image'])}:{w()}.{r.choice(['svg', 'png'])}|thumb|{p()}]]", k, "residue")
            s.add("\n")
        elif choice == 4:
            s.add(f"[[Category:{w().title()}]]", k, "residue")
            s.add("\n")
        elif choice == 5:
            s.add(f"The '''{w()}''' is a ''{w()}'' {w()}. ", k)
        elif choice == 6:
            s.add("\n")
            s.add(f"{{{{Infobox {w()}\n", k, "table")
            for _ in range(r.randint(1, 4)):
                s.add(f"| {w()} = {r.choice([w(), n()])}\n", k, "table")
            s.add("}}\n", k, "table")
        elif choice == 7:
            s.add("{{" + f"{p(1, 2)}|{w()}" + "}} ", k)
            s.add(self.sentence() + " ")
        elif choice == 8:
            s.add("\n")
            s.add(f'{{| class="{r.choice(["wikitable", w()])}"\n', k, "table")
            s.add(f"! {w()}\n|-\n", k, "table")
            for _ in range(r.randint(1, 4)):
                s.add(f"| {r.choice([n(), p(1, 2)])}\n", k, "table")
            s.add("|}\n", k, "table")
        elif choice == 9:
            s.add(r.choice(["__TOC__", "__NOTOC__", "__NOEDITSECTION__", "#REDIRECT [[" + w().title() + "]]"]), k, "residue")
            s.add("\n")
        elif choice == 10:
            s.add("{{" + r.choice(["stub", "cite web|url=http://" + w() + ".org", "main|" + w(), "citation needed"]) + "}}", k)
            s.add(" ")
        elif choice == 11:
            s.add(f"See [http://{w()}.org/{w()} the {w()} site] and [[{w()}]]. ", k)
        else:
            s.add("\n")
            s.add(f"'''{p(1, 2).capitalize()}''' is {p(2, 6)}. ", k)

    def latex(self, s: Sample) -> None:
        r, w, p, n = self.r, self.name, self.phrase, self.number
        k = {"latex"}
        choice = r.randrange(14)
        if choice == 0:
            s.add("\n")
            s.add(f"\\{r.choice(['section', 'subsection', 'chapter', 'section*'])}{{{p(1, 3).capitalize()}}}", k, "heading")
            s.add(r.choice([" ", "\n"]) + self.sentence() + "\n")
        elif choice == 1:
            env = r.choice(["itemize", "enumerate"])
            s.add("\n")
            s.add(f"\\begin{{{env}}}\n", k, "list")
            for _ in range(r.randint(1, 4)):
                s.add(f"\\item {p(1, 5)}\n", k, "list")
            s.add(f"\\end{{{env}}}\n", k, "list")
        elif choice == 2:
            s.add(f"The \\textbf{{{p()}}} {w()} is \\emph{{{p()}}}. ", k)
        elif choice == 3:
            s.add(f"The {w()} is \\({self.formula()}\\) per {w()}. ", k)
        elif choice == 4:
            s.add(f"The {w()} is ${self.formula()}$ with $\\{r.choice(['alpha', 'beta', 'gamma'])} = 0.{n()}$. ", k)
        elif choice == 5:
            s.add(f"\\[ {self.formula()} \\]\n", k, "formula")
        elif choice == 6:
            s.add(f"$$ {self.formula()} $$\n", k, "formula")
        elif choice == 7:
            env = r.choice(["equation", "align", "equation*"])
            s.add("\n")
            s.add(f"\\begin{{{env}}}\n{self.formula()}\n\\end{{{env}}}\n", k, "formula")
        elif choice == 8:
            s.add(f"As shown in~\\ref{{fig:{w()}}} and \\cite{{{w()}{n()}}}, the {w()} is {w()}. ", k)
        elif choice == 9:
            s.add(f"\\footnote{{{self.sentence()}}} ", k)
        elif choice == 10:
            s.add("\n")
            s.add(f"\\begin{{{r.choice(['verbatim', 'lstlisting'])}}}\n{self.code_line()}\n\\end{{verbatim}}\n", k, "code")
        elif choice == 11:
            s.add(f"\\label{{{r.choice(['sec', 'fig', 'eq'])}:{w()}}}", k, "residue")
            s.add("\n")
        elif choice == 12:
            s.add("\n")
            s.add(f"\\begin{{tabular}}{{ll}}\n{w()} & {n()} \\\\\n\\hline\n{w()} & {n()} \\\\\n\\end{{tabular}}\n", k, "table")
        else:
            s.add(f"We have ${self.r.choice('xyznk')}_{self.r.choice('ijk')} = {self.formula()}$ here. ", k)

    def sample(self) -> Sample:
        """A text of one to eight paragraphs: most plain, some with look-alikes, some with markup of one or more formats."""
        r, s = self.r, Sample()
        used = r.sample(FORMATS, r.choice([0, 1, 1, 2, 2, 3, 4]))
        break_ = r.choice(["\n\n", "\n\n", "\n", "\r\n\r\n"])
        for k in range(r.randint(1, 8)):
            if k:
                s.add(break_)
            for _ in range(r.randint(0, 3)):
                s.add((self.lookalike() if r.random() < 0.25 else self.sentence()) + " ")
            if used and r.random() < 0.6:
                # Often several in a row, so that a leaf may hold more than one format.
                for _ in range(r.choice([1, 1, 1, 2, 2, 3])):
                    name = r.choice(used)
                    if r.random() < 0.25:
                        self.inline(name, s)
                    else:
                        getattr(self, name)(s)
                    if not s.text[-1:].isspace():
                        s.add(" ")
            if r.random() < 0.6:
                s.add(self.lookalike() if r.random() < 0.3 else self.sentence())
        return s


def samples(count: int, seed: int) -> list[Sample]:
    writer = Writer(seed)
    return [writer.sample() for _ in range(count)]
