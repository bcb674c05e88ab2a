from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from fathomry.llm.bisect import WHITE_SPACE, WORD, boundaries, split, split_oversized

NB = chr(0xA0)


def bodies(text, limit, overlap):
    found = split(text, limit, overlap)
    return [text[p["body_start"] : p["end"]] for p in found], found


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.,#-\n\r\t `|" + NB + chr(0x2003) + chr(0x1C), max_size=300), st.integers(1, 20), st.integers(0, 25))
def test_pieces_cover_all_words_within_the_limit(text, limit, overlap):
    parts, found = bodies(text, limit, overlap)
    words = [m.group() for m in WORD.finditer(text)]
    assert [w for p in parts for w in WORD.findall(p)] == words
    bound = min(overlap, limit - 1)
    for p in found:
        held = WORD.findall(text[p["start"] : p["end"]])
        assert len(held) == p["tokens"] <= limit
    for before, p in zip(found, found[1:]):
        at = len(WORD.findall(text[: p["body_start"]]))
        assert p["overlap"] == min(bound, at)
        assert WORD.findall(text[p["start"] : p["body_start"]]) == words[at - p["overlap"] : at]
        # Exact round trip: nothing but blanks lies between two bodies.
        assert not text[before["end"] : p["body_start"]].strip(WHITE_SPACE)
    assert len(found) == 1 if 0 < len(words) <= limit else True


def test_cuts_at_the_strongest_boundary_near_the_middle():
    text = "a b c d. e f g h.\n\ni j k l. m n o p."
    parts, found = bodies(text, 10, 2)
    assert parts == ["a b c d. e f g h.", "i j k l. m n o p."]
    assert [p["boundary"] for p in found] == ["start", "paragraph"]
    assert text[found[1]["start"] :].startswith("g h.\n\ni j")
    parts, _ = bodies("one two three four. five six seven eight", 6, 1)
    assert parts == ["one two three four.", "five six seven eight"]
    assert [len(p.split()) for p in bodies("w " * 9, 4, 0)[0]] == [4, 2, 3]


def test_code_is_cut_last():
    text = "para one two\n\n```py\nx = 1\n\ny = 2\n```\n\nlast para here"
    parts, _ = bodies(text, 12, 0)
    assert any("```py\nx = 1\n\ny = 2\n```" in p for p in parts)
    _, cuts = boundaries("- a b\n- c d\n| e | f |\n# g")
    assert cuts == [0, 1, 1, 5, 1, 1, 5, 1, 1, 1, 1, 5, 1]


def test_odd_sizes():
    assert split(None, 5, 1) == [] == split("", 5, 1) == split(" \n", 5, 1)
    for limit in (None, 0, -3, float("nan")):
        assert len(split("a b c", limit, 1)) == 1
    assert [p["tokens"] for p in split("a b c", 1, 9)] == [1, 1, 1]
    assert all(p["tokens"] <= 3 for p in split("a b c d e f", 3, None))


def test_items(spark):
    configs = spark.createDataFrame([("s", 4, 1, 9), ("s", 4, 1, 8), ("n", None, 1, 9), (None, 3, 1, 9)], "config_name string, max_tokens int, overlap_tokens int, record int")
    long = " ".join(f"w{i}." for i in range(20_000))
    rows = [
        ("a", "x y z", ["H"], "s", 1), ("b", f"a{NB}b c d e", ["H", "I"], "s", 99), ("b", f"a{NB}b c d e", ["H", "I"], "s", 99), ("c", "a b c d e", None, "n", 1), ("d", "a b c d e", [], None, 1), ("e", None, [], "s", 1),
        ("f", "", [], "s", 1), (None, "a b c d e", [], "s", 1), ("g", long, None, "s", None), ("h", "a b c d e", [], "unknown", 1),
    ]
    items = spark.createDataFrame([(*r, 0, "most") for r in rows], "chunk_id string, content string, heading_path array<string>, config_name string, token_count int, record int, most string")
    got = split_oversized(items, configs).collect()
    assert {r.record for r in got} == {"b", "g"}
    b = sorted((r for r in got if r.record == "b"), key=lambda r: r.piece)
    assert len(b) == 2 and all(r.heading_path == ["H", "I"] and r.pieces == 2 and r.token_count <= 4 for r in b)
    g = sorted((r for r in got if r.record == "g"), key=lambda r: r.piece)
    assert " ".join(long[r.body_start : r.body_end] for r in g) == long and all(r.heading_path is None for r in g)
    assert split_oversized(items.limit(0), configs).count() == 0 == split_oversized(items, configs.limit(0)).count()
    assert re.fullmatch(r"a\xa0b", b[0].content) and re.fullmatch(r"b c d e", b[1].content)
