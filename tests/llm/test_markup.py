from __future__ import annotations

import numpy as np
import pytest

from fathomry.llm.bilstm import Labeller, pad
from fathomry.llm.leaves import WIDTH, leaves, vectors
from fathomry.llm.markup import FORMATS, Settings, clean, formats_of, label, label_texts, targets, trained
from fathomry.llm.markup_samples import samples


def read(text):
    found, flags, classes = label(trained(), [text])[0]
    formats = formats_of(flags, Settings().threshold)
    return set().union(*formats) if formats else set(), clean(text, found, formats, classes)


def test_gradients_are_right():
    model = Labeller.new(5, 3, 2, 3, 0)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    rng = np.random.default_rng(1)
    x, lengths = rng.normal(size=(2, 4, 5)), np.array([4, 2])
    flags, classes = rng.integers(0, 2, (2, 4, 2)).astype(float), rng.integers(0, 3, (2, 4))
    _, grads = model.gradients(x, lengths, flags, classes)
    for name, w in model.weights.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w.shape)
            kept = w[at]
            w[at] = kept + 1e-5
            up = model.gradients(x, lengths, flags, classes)[0]
            w[at] = kept - 1e-5
            down = model.gradients(x, lengths, flags, classes)[0]
            w[at] = kept
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_padding_changes_nothing():
    model = Labeller.new(4, 3, 2, 2, 0)
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(3, 4)).astype(np.float32), rng.normal(size=(7, 4)).astype(np.float32)
    x, lengths = pad([a, b])
    alone, _ = model.scores(*pad([a]))
    together, _ = model.scores(x, lengths)
    assert np.allclose(alone[0], together[0, :3], atol=1e-6)


def test_held_out_accuracy():
    """Samples of another seed, none of which was trained on."""
    held = [s for s in samples(400, 4242) if leaves(s.text)]
    right = found_right = wrong = missed = total = 0
    for s, (found, flags, classes) in zip(held, label(trained(), [s.text for s in held])):
        y, c = targets(s, found)
        p = flags >= 0.5
        found_right += (p & (y > 0)).sum()
        wrong += (p & (y == 0)).sum()
        missed += (~p & (y > 0)).sum()
        right += (classes == c).sum()
        total += len(c)
    assert found_right / (found_right + missed) > 0.97 and found_right / (found_right + wrong) > 0.97 and right / total > 0.97


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("The <b>cold</b> node &amp; its <a href='x'>link</a>.", {"html"}), ("<!-- note -->\nText.", {"html"}), ("## Title\n\nSome text.", {"markdown"}), ("See [the page](../a.md) and **this**.", {"markdown"}),
        ("Steps:\n\n- load it\n- drop it\n", {"markdown"}), ("```sh\nrun --x\n```\nDone.", {"markdown"}), ("| a | b |\n|---|---|\n| 1 | 2 |", {"markdown"}), ("== Title ==\nThe [[page]] is '''bold'''.", {"wiki"}),
        ("{{Infobox x\n| owner = y\n}}\nText.", {"wiki"}), ('{| class="wikitable"\n! a\n|-\n| 1\n|}', {"wiki"}), ("\\section{One} Text with $\\alpha + 1$ and \\emph{more}.", {"latex"}), ("\\begin{itemize}\n\\item one\n\\end{itemize}", {"latex"}),
        ("Mixed <i>one</i>.\n\n[[Two]] and \\cite{three}.", {"html", "wiki", "latex"}),
        ("It holds while a < b and c > 2. The map is a HashMap<u64, Chunk>.", set()), ("It costs $40 a month, or $5 a day.", set()), ("Use max_file_size and C:\\data\\new.", set()), ("Pipe a | b works - well - today.", set()),
        ("We tried 2 * 3 * 54 workers & more.", set()), ("Issue #16 covers item[0], see [3].", set()), ("Plain prose only.", set()), ("", set()),
    ],
)
def test_kinds(text, kinds):
    assert read(text)[0] == kinds


def test_cleaning_keeps_structure():
    text = "## Set *up*\n\nSee [the page](a.md).\n\n- one `x`\n- two\n\n```py\nx = 1\n\ny = **2\n```\n\n<p>A &lt; B</p>\n\n$$ \\frac{a}{b} $$\n\nThe [[Topic|thing]] is \\textbf{big}."
    _, (cleaned, blocks) = read(text)
    assert cleaned == "Set up\n\nSee the page.\n\n- one x\n- two\n\nx = 1\n\ny = **2\n\nA < B\n\n$$ \\frac{a}{b} $$\n\nThe thing is big."
    kinds = [k for k, _ in blocks]
    assert kinds[0] == "heading" and "list" in kinds and "code" in kinds and "formula" in kinds
    plain = "Nothing here.\r\n\r\nAt all,\u2003really - a < b."
    assert read(plain)[1][0] == plain


def test_whole_texts_are_read():
    text = "word. " * 30_000 + "\n\n" + "- item\n" * 3000 + "\nThe <b>end</b>."
    assert read(text)[0] == {"markdown", "html"}
    found = leaves(text)
    assert found[-1].end == len(text) and vectors("a b", leaves("a b")).shape == (1, WIDTH)


def test_structures_of_any_depth():
    deep = "<div>" * 40 + "\n```\n**code**\n</div>\n```\n" + "</div>" * 39 + "\n\nText in the outermost one.\n</div>\nText after it."
    found = leaves(deep)
    at = {deep[x.start : x.end]: x.path for x in found}
    assert at["**code**"].has("fence") and at["**code**"].depth == 41
    assert at["Text in the outermost one."].names() == ["tag:div"] and at["Text after it."].depth == 0
    # Very many structures that never close, and closings of none, cost no more than others.
    long = "<div>\n" * 20_000 + "</p>\n" * 20_000
    found = leaves(long)
    assert found[-1].path.depth == 20_000 and np.isfinite(vectors(long, found)).all()


def test_the_network_decides():
    """Without its recurrent layers the model says formats of prose."""
    prose = ["It holds while a < b and c > 2. The map is a HashMap<u64, Chunk>.", "Use max_file_size and C:\\data\\new.", "It costs $40 a month."]
    whole = trained()
    blind = Labeller({k: v if k.startswith("out") else np.zeros_like(v) for k, v in whole.weights.items()}, whole.flags)
    said = lambda model: [set().union(*formats_of(flags, Settings().threshold)) for _, flags, _ in label(model, prose)]
    assert said(whole) == [set()] * 3 and said(blind) != [set()] * 3


def test_rows(spark):
    rows = [("a", "<b>x</b> y"), ("a", "<b>x</b> y"), ("b", None), (None, "<b>x</b>"), ("c", ""), ("d", "plain")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "chunk_id string, content string, record int, text string")
    got = sorted((r.record, tuple(r.formats), r.clean_text, len(r.blocks)) for r in label_texts(df, "chunk_id", "content").collect())
    assert got == [("a", ("html",), "x y", 1), ("a", ("html",), "x y", 1), ("c", (), "", 0), ("d", (), "plain", 1)]
    assert [r.record for r in label_texts(df, "chunk_id", "content", cleaning=False).collect()] == ["a", "a"]
    assert label_texts(df.limit(0), "chunk_id", "content").count() == 0
    assert FORMATS == ("html", "markdown", "wiki", "latex")
