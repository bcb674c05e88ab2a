from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fathomry.functions.ranking import by_size, place, running, totals
from fathomry.functions.scoring import fetch_depth, fused_score, hybrid_depth
from fathomry.operators.keyword import keyword_candidates, term_stats
from fathomry.operators.search import EmptyQuery, ModelMismatch, check_model, run_records, run_summary, search
from fathomry.operators.vector import vector_candidates

CHUNKS = "chunk_id string, document_id string, source_path string, content string, preview string, heading_path array<string>, status string"
DOCS_WITH_MODEL = "id string, project string, tags array<string>, status string, embedding_model string, embedding_dimension int, source_path string"
DOCS = "id string, project string, tags array<string>, status string, source_path string, embedding_model string, embedding_dimension int"


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("c1", "d1", "a.md", "deploy the service", "p1", ["A"]), ("c2", "d2", "b.md", "deploy deploy with care", "p2", []), ("c3", "d3", "c.md", "rollback the service", "p3", None),
        ("c4", "d4", "a.md", "deploy notes", "p4", []), ("c5", "gone", "e.md", "deploy orphan", "p5", []), ("c6", "d6", "f.md", "deploy deleted", "p6", []), ("c7", "d1", "a.md", None, None, None),
    ]
    chunks = spark.createDataFrame([(*r, "clash") for r in rows], CHUNKS)
    docs = spark.createDataFrame(
        [("d1", "x", ["t", "u"], "Active", "a.md", "m", 2), ("d2", "y", ["t"], "Active", "b.md", "m", 2), ("d3", "x", None, "Active", "c.md", "m", 2), ("d4", "x", ["t", "u"], "Modified", "a.md", "m", 2), ("d6", "x", ["t"], "Deleted", "f.md", "m", 2)], DOCS
    )
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.9, 0.1]), ("c3", [0.0, 1.0]), ("c4", [0.8, 0.2]), ("c6", [1.0, 0.0]), ("c7", None), ("c8", [1.0, 0.0])], "chunk_id string, vector array<double>")
    return chunks, docs, vectors


def asked(spark, **filters):
    df = spark.createDataFrame([("q", "Deploy!", [1.0, 0.0])], "query_id string, text string, vector array<double>")
    for name, value in filters.items():
        df = df.withColumn(name, value)
    return df


def ids(df):
    return [r.chunk_id for r in df.orderBy("rank").collect()]


def test_depths(spark):
    row = spark.range(1).select(fetch_depth(8, False), fetch_depth(8, True), fetch_depth(0, False), hybrid_depth(8, False), hybrid_depth(1, False), hybrid_depth(0, False)).first()
    assert list(row) == [8, 40, 1, 40, 5, 5]


def test_fusion(spark):
    n = F.lit(None).cast("int")
    row = spark.range(1).select(fused_score(F.lit(1), F.lit(1)), fused_score(n, n), fused_score(F.lit(3), F.lit(7)) - fused_score(F.lit(7), F.lit(3))).first()
    assert [round(x, 9) for x in row] == [1.0, 0.0, 0.0]


def test_modes(spark, index):
    chunks, docs, vectors = index
    assert ids(search(asked(spark), chunks, docs, "vector", 3, vectors)) == ["c1"]  # c6 is deleted, c8 has no chunk, and nothing more was fetched
    assert ids(search(asked(spark), chunks, docs, "vector", 5, vectors)) == ["c1", "c2", "c4"]
    assert set(ids(search(asked(spark), chunks, docs, "keyword", 9))) == {"c1", "c2", "c4"}
    hybrid = search(asked(spark), chunks, docs, "hybrid", 3, vectors, explain=True).orderBy("rank").collect()
    assert [r.rank for r in hybrid] == [1, 2, 3] and all(0 <= r.score <= 1 for r in hybrid)
    assert "knn #" in hybrid[0].reason and hybrid[0].reason.endswith("passed no filter(s)")


def test_filters(spark, index):
    chunks, docs, vectors = index
    tags = F.array(F.lit("t"), F.lit("u"))
    assert set(ids(search(asked(spark, project=F.lit("x"), tags=tags, source=F.lit("a.md")), chunks, docs, "keyword", 9))) == {"c1", "c4"}
    assert ids(search(asked(spark, project=F.lit("y")), chunks, docs, "keyword", 1, exact_filter=True)) == ["c2"]
    assert ids(search(asked(spark, project=F.lit("none")), chunks, docs, "hybrid", 3, vectors)) == []


def test_bad_input(spark, index):
    chunks, docs, vectors = index
    for mode, k in (("fuzzy", 3), ("keyword", 0)):
        with pytest.raises(ValueError):
            search(asked(spark), chunks, docs, mode, k)
    with pytest.raises(ModelMismatch):
        check_model(docs, "m", 3)
    check_model(docs, "m", 2)
    check_model(docs.limit(0), "m", 3)
    blank = spark.createDataFrame([("q", "  "), ("r", None)], "query_id string, text string")
    assert search(blank, chunks, docs, "keyword", 3, skip_blank=True).count() == 0
    with pytest.raises(EmptyQuery):
        search(blank, chunks, docs, "keyword", 3)


def test_empty_index(spark, index):
    chunks, docs, vectors = index
    assert search(asked(spark), chunks.limit(0), docs.limit(0), "hybrid", 3, vectors.limit(0)).count() == 0
    assert run_summary(asked(spark), search(asked(spark), chunks.limit(0), docs, "keyword", 3), "keyword").first().n_results == 0


def test_keyword_ties_and_normalisation(spark):
    rows = spark.createDataFrame([(i, "same words here") for i in (3, 1, 2)] + [(4, ""), (5, None)], "id int, text string")
    q = spark.createDataFrame([("q", "same WORDS same")], "query_id string, text string")
    found = keyword_candidates(q, rows, "id", "text", 2).orderBy("keyword_rank").collect()
    assert [r.record for r in found] == [1, 2] and found[0].raw_score == found[1].raw_score > 0
    assert keyword_candidates(q, rows.limit(0), "id", "text", 3).count() == 0


def test_vector_ties_nulls_and_depths(spark):
    vectors = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("s", [1.0]), ("f", [float("nan"), 1.0])], "id string, v array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0], 5), ("p", None, 1)], "query_id string, vector array<double>, depth int")
    found = vector_candidates(q, vectors, "id", "v", "depth").orderBy("vector_rank").collect()
    assert [(r.record, r.distance) for r in found] == [("a", 0.0), ("b", 0.0), ("z", 1.0)]
    assert vector_candidates(q.limit(0), vectors, "id", "v", 3).count() == 0


@pytest.mark.parametrize("hot", [1, 150, 1000])
def test_places_and_sums_do_not_depend_on_the_form(spark, hot):
    from pyspark.sql import Window as W

    rows = spark.range(500).select(F.when(F.col("id") % 7 > 1, F.lit(0)).otherwise(F.col("id") % 3).alias("g"), "id", F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 100) / 100.0).alias("s"))
    order = [F.desc_nulls_last("s"), F.asc("id")]

    def build(part, split):
        part = place(part, ["g"], order, "r", split)
        part = running(part, ["g"], [F.desc("id")], F.col("id") % 5, "before", split)
        return totals(part, ["g"], {"n": F.count(F.lit(1)), "top": F.max("s")}, split).select("g", "id", "r", "before", "n", "top")

    found = by_size(rows, ["g"], build, hot).join(rows, ["g", "id"])
    ordered = W.partitionBy("g").orderBy(*order)
    backwards = W.partitionBy("g").orderBy(F.desc("id")).rowsBetween(W.unboundedPreceding, -1)
    checked = found.withColumn("p", F.row_number().over(ordered) - 1).withColumn("b", F.coalesce(F.sum(F.col("id") % 5).over(backwards), F.lit(0)))
    checked = checked.withColumn("m", F.count(F.lit(1)).over(W.partitionBy("g"))).withColumn("t", F.max("s").over(W.partitionBy("g")))
    assert found.count() == 500 and checked.where("p <> r or b <> before or m <> n or t <> top").count() == 0


def test_searching_in_parts_and_blocks_gives_the_same(spark, monkeypatch):
    from fathomry.operators import keyword, topk, vector

    r = random.Random(3)
    words = ["ab", "cd", "ef", "gh", "ij", "kl"]
    rows = spark.createDataFrame([(i, " ".join(r.choices(words, k=r.randint(0, 9))), [r.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(300)], "id int, text string, v array<double>").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", " ".join(r.choices(words, k=2)), [r.random() for _ in range(3)], i % 5 + 1) for i in range(23)], "query_id string, text string, vector array<double>, depth int")

    def both():
        k = keyword_candidates(asked, rows, "id", "text", "depth").collect()
        v = vector_candidates(asked, rows, "id", "v", "depth").collect()
        return {(x.query_id, x.record, round(x.raw_score, 6), x.keyword_rank) for x in k}, {(x.query_id, x.record, x.distance, x.vector_rank) for x in v}

    whole = both()
    assert len(whole[0]) == len(whole[1]) == sum(i % 5 + 1 for i in range(23))
    monkeypatch.setattr(topk.in_batches, "__defaults__", (4,))
    for module in (keyword, vector):
        monkeypatch.setattr(module, "CELLS", 20)
    assert both() == whole


def test_guards_and_run_records(spark):
    docs = spark.createDataFrame([("d1", None, None, "Active", "m", 2, "p")], DOCS_WITH_MODEL)
    chunks = spark.createDataFrame([("c1", "d1", "p", "alpha", "alpha", None, "x"), ("c2", "d1", "p", "beta", "beta", None, "x")], CHUNKS)
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.1, 1.0])], "chunk_id string, vector array<double>")
    asked = spark.createDataFrame([("q1", "alpha", [1.0, 0.0], "r1", "pr", ["a", "b"], None), ("q2", "none", [0.0, -1.0], "r2", None, None, "s/x")], "query_id string, text string, vector array<double>, retrieval_run_id string, project string, tags array<string>, source string")
    plain = asked.select("query_id", "text", "vector", "retrieval_run_id")
    with pytest.raises(ModelMismatch):
        search(plain, chunks, docs, "vector", 2, vectors, model=("other", 2))
    with pytest.raises(ValueError, match="3 values"):
        search(plain.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))), chunks, docs, "hybrid", 2, vectors, model=("m", 2))
    # Keyword search needs no vectors, so their model does not matter.
    assert search(plain, chunks, docs, "keyword", 2, model=("other", 2)).count() == 1
    found = search(plain, chunks, docs, "vector", 2, vectors, model=("m", 2))
    first, second = run_records(asked, found, docs, "vector", 2, 12.5, "2025-01-01").orderBy("query_id").collect()
    assert (first.retrieval_run_id, first.reason, first.latency_ms, first.below_threshold_count, [r.chunk_id for r in first.results]) == ("r1", "ok", 12.5, 1, ["c1", "c2"])
    assert first.filters == "project=pr  tag=a  tag=b" and second.filters == "source=s/x" and second.below_threshold_count == 2
    empty = run_records(plain.drop("retrieval_run_id"), found.limit(0), docs.withColumn("status", F.lit("Deleted")), "vector", 2, 1, "t").first()
    assert (empty.reason, empty.results, empty.filters) == ("indexEmpty", [], "(none)") and empty.retrieval_run_id.startswith("rrun_")


def test_term_counts(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, "B c"), (3, None), (4, ""), (None, "a")], "id int, text string")
    assert {(r.term, r.df, r.occurrences) for r in term_stats(rows, "id", "text").collect()} == {("a", 1, 2), ("b", 2, 2), ("c", 1, 1)}
