from __future__ import annotations

import pytest

from fathomry.llm.truncation import ending, source_baselines, endings, truncated, truncation_report

COMPLETE = [
    "All done.", "Is it?", 'He said "yes."', "See (the note above.)", "List:\n\n- store the snapshot", "```\nload --x 1\n```", "| a | 3 |", "Text.\n\nNext: https://docs.example/label/writer",
    "Text.\n\nKeywords: chunk, document, bucket", "Text.\n\nStatus: full", "Text.\n\nThanks, the platform team", "Text.\n\n-- quality docs", "See [the page](a/b.md)", "== Title ==", "Fin。", "1. load it\n2. drop it", "Text.\n\n* One.\n* Two.",
    "It holds in [0, 1) and (see the note) :-( still.", 'The 5" disk is full.', "<p>One.\n<p>Two.", "<div><p>Done.</p></div>", "Say **this**.", "The call f(x[0]) is `a(` here.", "Two ** three, and 2 * 3.", "a) One.\nb) Two.",
    "A **mark left open\n\nin another paragraph.", "\\begin{itemize}\n\\item one.\n\\end{itemize}", "The '(' sign is kept.", 'He said "one.\n\n"And two."', "{| class=x\n| a\n|}", "If a <b we stop.",
    "* One thing happened.\n* Another thing was.\n\n- monitor the writer", "1. One is done.\n2. Two is done.\n\n- pin it",
]
CUT = [
    "If the filename is slow, index the batch and check the man", "It grew by", "A sentence, and", "The list:\n\n1. All good.\n2.", "```\nload --docu", "Text.\n\n| status | 1", "== Ranki", "Text.\n\n# Rank", "> The reader and the l", "Broken char s" + chr(0xFFFD),
    "<div><p>Hello world.", 'He wrote "half.', "He said (see the note.\n\nThen more text.", "\\begin{itemize}\n\\item one.", "A [link to.\n\n- item", "It is **bold.", "Run `this.", "{{Infobox\n| a = b.", "<!-- a note.\n\nStatus: full", "Text. <a href=\"x",
    "```\n)\n```\nThen (open.", "$$ a + b.", "\\begin{verbatim}\n\\end{other} x.",
    "Escape \\u00", "Entity &am", "Open (bracket here", "* One thing happened.\n* Another thing was", "Release.\n\n* The quiet log was renamed at the", "1. It is done.\n2. It", "search: The queue grew by", "Mark after a cut wor [cut]", "and the shard was expe…", "We monitor the artifact before the second dashboar...", "Q: Can we load the seg",
]


@pytest.mark.parametrize("text", COMPLETE)
def test_complete(text):
    kind, marked, broken = ending(text)
    assert (kind in ("complete", "remark")) and not broken


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    kind, marked, broken = ending(text)
    assert broken or kind in ("open", "bare")


def test_marks_and_remarks():
    assert ending("All is well.\n\nMore to come...") == ("remark", False, False)
    assert ending("It is whole. [cut]") == ("complete", True, False)
    assert ending(None)[0] == ending("")[0] == ending(" \n ")[0] == "empty"
    assert ending("x" * 500_000)[0] == "bare"


def test_sign_offs_are_told_from_openings(spark):
    """A last line that begins as sentences do elsewhere is the beginning of one."""
    whole = [(i, f"The {NOUNS[i]} was moved. Also, it was checked.\n\nGreetings, the {NOUNS[i + 1]} team", "s") for i in range(9)]
    cut = [(100 + i, f"The {NOUNS[i]} was moved.\n\nAlso, the {NOUNS[i + 2]}", "t") for i in range(5)]
    assert sorted(r.record for r in truncated(frame(spark, whole + cut)).where("truncated").collect()) == [100, 101, 102, 103, 104]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", True) for r in rows], "doc_id long, text string, source string, kind string, marked boolean")


def test_limits_by_source(spark):
    whole = [(i, "A sentence that ends well." + " More words here." * (i % 5), "s") for i in range(30)]
    limited = [(100 + i, ("words and " * 20)[:120], "s") for i in range(5)]
    # Exactly as long as the field allows, ending in a line that could be complete.
    status = "Status: healthy"
    at_limit = [(200, "x" * (121 - len(status) - 2) + ".\n" + status[:-1], "s"), (201, "Short.\n" + status, "s")]
    rows = whole + limited + at_limit + [(300, None, None), (301, "cut of", None), (302, "", "s"), (None, "cut of", "s"), (303, "cut of", "t"), (303, "cut of", "t")]
    got = truncated(frame(spark, rows)).collect()
    bad = sorted(r.record for r in got if r.truncated)
    assert bad == [100, 101, 102, 103, 104, 200, 301, 303, 303]
    assert {r.record: r.reason for r in got}[200] == "limit"
    limits = {r.source: r.char_limit for r in source_baselines(endings(frame(spark, rows), "doc_id", "text", "source")).collect()}
    assert limits["s"] == 120 and limits["t"] is None and None in limits
    report = {r.source: r for r in truncation_report(truncated(frame(spark, rows))).collect()}
    assert (report["s"].n_truncated, report["s"].n_bare, report["s"].n_limit) == (6, 5, 1) and report[None].rate == 0.5
    assert truncated(frame(spark, [])).count() == 0


def test_terse_sources(spark):
    rows = [(i, f"note number {i} of the log {'x' * i}", "terse") for i in range(40)] + [(99, "(open", "terse")]
    assert [r.record for r in truncated(frame(spark, rows)).where("truncated").collect()] == [99]


NOUNS = "reader writer bucket segment ledger queue harness filename dashboard archive boundary document snapshot incident".split()


def prose(i):
    a, b, c, d = (NOUNS[(i * k + k) % len(NOUNS)] for k in (1, 3, 5, 9))
    return f"The {a} grew after the {b} was measured again. Ask the {c} team before you move a {d}, because the {a} holds it. "


def test_sources_of_cuts_are_not_terse(spark):
    """Cuts of many lengths, more of them than of whole texts, at any number of texts."""
    for total in (10, 19, 20, 100):
        cut = [(i, (prose(i) + prose(i + 5))[: 90 + (i * 37) % 110].rstrip(), "b") for i in range(total * 7 // 10)]
        cut = [(i, t if ending(t)[0] != "complete" else t[:-3], s) for i, t, s in cut]
        rows = cut + [(1000 + i, prose(i).strip(), "b") for i in range(total - len(cut))]
        assert sorted(r.record for r in truncated(frame(spark, rows)).where("truncated").collect()) == [i for i, _, _ in cut]


def test_cuts_at_a_limit_below_an_outlier(spark):
    cut = [(i, (prose(i) + prose(i + 3))[:120].rstrip(" ."), "o") for i in range(30)]
    rows = cut + [(100 + i, prose(i).strip(), "o") for i in range(8)] + [(200, (prose(1) * 5).strip(), "o")]
    assert sorted(r.record for r in truncated(frame(spark, rows)).where("truncated").collect()) == list(range(30))


def test_cuts_in_terse_sources(spark):
    """Notes without terminators are whole, but not those that end in a word, at a function word or at a comma."""
    notes = [(i, f"moved the {NOUNS[i % 14]} {7 ** (i % 19)} times to the {NOUNS[(i * 3 + 1) % 14]}", "n") for i in range(60)]
    cut = [(100, "moved the dashboard to the arch", "n"), (101, "moved the dashboard to the", "n"), (102, "moved the dashboard,", "n")]
    whole = [(103, "moved it to dashboard archive", "n"), (104, "deployed v7 again", "n")]
    kept = [(200, "brought it back from the archive of the old harness to the reader", "n")]
    got = {r.record: r.reason for r in truncated(frame(spark, notes + cut + whole + kept)).where("truncated").collect()}
    assert got == {100: "bare", 101: "bare", 102: "bare"}


def test_limits_between_words_and_below_longer_texts(spark):
    """A limit kept by whole words, and one that later texts exceed, hold for ends that look complete too."""
    def words(i, most):
        kept = (prose(i) + prose(i + 3) + prose(i + 5))[: most + 1].rsplit(" ", 1)[0]
        return kept if ending(kept)[0] != "complete" else kept.rstrip(".") + " of"

    listed = lambda most: "y" * (most - 22) + ".\n\nThanks, all of the"
    for most, name in ((160, "v"),):
        cut = [(i, words(i, most), name) for i in range(40)] + [(90, listed(most - 3), name)]
        whole = [(100 + i, prose(i).strip() + " It is so." * (i % 30), name) for i in range(60)] + [(200, listed(most - 60), name), (201, (prose(2) * 9).strip(), name)]
        got = {r.record: (r.reason, r.at_limit) for r in truncated(frame(spark, cut + whole)).where("truncated").collect()}
        assert sorted(got) == [r[0] for r in cut] and got[90] == ("limit", True)
