from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomry.operators.chunking import ChunkingConfig, chunk_documents, pack, sections, words

FENCE = "# T\n\nbefore text\n\n```\na b c d e f g\n\nh i\n```\n\nafter\n"


def contents(text, config, markdown=True):
    return [c for s in sections(text, markdown) for c in pack(s, config)]


def test_config_is_checked():
    for bad in ((500, 400, 80), (100, 800, 200), (1, 2, -1)):
        with pytest.raises(ValueError):
            ChunkingConfig(*bad)


def test_blank_documents_have_no_chunks(spark):
    rows = spark.createDataFrame([("d", "md", "   \n\n  "), ("e", "txt", None), ("f", "md", "# only heading")], "document_id string, extension string, text string")
    assert chunk_documents(rows).count() == 0
    assert chunk_documents(rows.limit(0)).count() == 0


def test_heading_paths(spark):
    rows = spark.createDataFrame([("d", "md", "# Top\n\nintro\n\n## Sub\n\nbody text here\n", 1)], "document_id string, extension string, text string, chunk_id int")
    found = chunk_documents(rows, ChunkingConfig(50, 100, 0)).orderBy("chunk_index").collect()
    assert [c.heading_path for c in found] == [["Top"], ["Top", "Sub"]]
    assert [c.chunk_index for c in found] == [0, 1] and found[0].document_id == "d" and found[1].token_count == 3


def test_heading_levels():
    assert [s.path for s in sections("# A\nx\n### B\ny\n## C\nz\n#tag\nw\n####### no", True)] == [["A"], ["A", "B"], ["A", "C"], ["tag"]]


def test_code_stays_whole():
    found = contents(FENCE, ChunkingConfig(3, 5, 0))
    assert sum("```\na b c d e f g\n\nh i\n```" in c for c in found) == 1


def test_any_fence_closes_and_an_open_one_runs_on():
    assert sections("~~~\na\n```\nb", True)[0].units == [(True, "~~~\na\n```"), (False, "b")]
    assert sections("```\na\n\n# no heading", True)[0].units == [(True, "```\na\n\n# no heading")]


def test_plain_text():
    found = contents("alpha beta gamma\n\ndelta epsilon zeta\n\neta theta iota", ChunkingConfig(2, 3, 0), False)
    assert found == ["alpha beta gamma", "delta epsilon zeta", "eta theta iota"]
    assert sections("a\r\nb\r\n\r\n# c", False)[0].units == [(False, "a\nb"), (False, "# c")]


def test_overlap_and_tail_only_chunks():
    text = "a b c d\n\ne f g h"
    assert contents(text, ChunkingConfig(4, 6, 2), False) == ["a b c d", "c d\n\ne f g h", "g h"]
    assert contents(text, ChunkingConfig(4, 6, 2, drop_tails=True), False) == ["a b c d", "c d\n\ne f g h"]


def test_oversized_paragraphs():
    long = " ".join(str(i) for i in range(20))
    assert contents(long, ChunkingConfig(4, 6, 0), False) == [long]
    assert max(len(words(c)) for c in contents(long, ChunkingConfig(4, 6, 2, split_oversized=True), False)) <= 6


def test_overlap_does_not_survive_large_code():
    code = "```\n" + " ".join("x" * 10) + "\n```"
    found = contents(f"a b c d\n\n{code}\n\ne", ChunkingConfig(4, 6, 2))
    assert found == ["a b c d", "c d", code, "e"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a b c", "# H", "```", "", "x", "## Two", "~~~", "one two three four five six"]), max_size=25))
def test_no_word_is_lost(lines):
    text = "\n".join(lines)
    units = [u for s in sections(text, True) for _, u in s.units]
    found = contents(text, ChunkingConfig(4, 6, 0))
    assert [w for c in found for w in words(c)] == [w for u in units for w in words(u)]
