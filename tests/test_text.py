from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fathomry.functions import text
from fathomry.functions.ids import chunk_id, content_hash, document_id
from fathomry.functions.paths import extension, path_matches, under
from fathomry.functions.vectors import cosine, mock_embedding, similarity, usable

KELVIN = chr(0x212A)


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "given,expected",
    [("zipDeploy 403 npm-ci", ["zipdeploy", "403", "npm", "ci"]), (KELVIN + "elvin", ["elvin"]), ("", []), ("Ünï x_1", ["n", "x", "1"]), (None, None)],
)
def test_terms(spark, given, expected):
    assert one(spark, given, text.terms) == expected


@pytest.mark.parametrize("given,expected", [("a b\xa0c d", 4), ("", 0), ("   ", 0), (" x ", 1), ("a" + chr(0x2003) + "b" + chr(0x3000), 2)])
def test_word_count_knows_unicode_blanks(spark, given, expected):
    assert one(spark, given, text.word_count) == expected


def test_preview(spark):
    assert one(spark, " a \n b ", text.preview) == "a b"
    assert one(spark, "x" * 120, text.preview) == "x" * 120
    assert one(spark, "x" * 121, text.preview) == "x" * 120 + "…"
    assert one(spark, None, text.preview) is None


def test_last_words(spark):
    assert one(spark, "a b c", lambda c: text.last_words(c, 2)) == "b c"
    assert one(spark, "a", lambda c: text.last_words(c, 5)) == "a"
    assert one(spark, "a b", lambda c: text.last_words(c, 0)) == ""
    assert one(spark, "", lambda c: text.last_words(c, 3)) == ""


@pytest.mark.parametrize("given,expected", [("x\n  # Top \n# Two", "Top"), ("#no", None), ("", None), ("```\n# in code\n```", "in code")])
def test_title(spark, given, expected):
    assert one(spark, given, text.markdown_title) == expected


def test_ids(spark):
    row = spark.range(1).select(
        document_id(F.lit("a.md")).alias("d"), chunk_id(F.lit("doc_1"), F.lit(0), F.lit("h")).alias("c"), content_hash(F.lit("é")).alias("h")
    ).first()
    assert row.d.startswith("doc_") and len(row.d) == 20 and row.c.startswith("chunk_") and len(row.h) == 64


@pytest.mark.parametrize(
    "indexed,expected,same",
    [("docs/arch.md", "./docs\\arch.md", True), ("x/docs/arch.md", "docs/arch.md", True), ("a/README.md", "b/readme.md", True), ("Docs/A.md", "docs/a.md", True), ("docs/arch.md", "docs/other.md", False)],
)
def test_paths(spark, indexed, expected, same):
    df = spark.createDataFrame([(indexed, expected)], "a string, b string")
    assert df.select(path_matches(F.col("a"), F.col("b"))).first()[0] is same


def test_extension_and_under(spark):
    rows = spark.createDataFrame([("a/b.MD",), ("a/.env",), ("a.d/b",), ("docs2/x",), ("docs/x",)], "p string")
    assert [r[0] for r in rows.select(extension(F.col("p"))).collect()] == ["md", "", "", "", ""]
    assert [r[0] for r in rows.select(under(F.col("p"), "docs/")).collect()] == [False, False, False, False, True]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, None, None]
    assert [round(x, 3) for x in spark.range(1).select(*[similarity(F.lit(d)) for d in (0.0, 1.0, 1.5, -0.2)]).first()] == [1, 0, 0, 1]
    bad = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0, float("inf")],), ([1.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in bad.select(usable(F.col("v"), 2)).collect()] == [True] + [False] * 6
    v = spark.range(1).select(mock_embedding(F.lit("x"), 40)).first()[0]
    assert len(v) == 40 and v[:8] == v[32:] and all(0 <= x <= 1 for x in v)
