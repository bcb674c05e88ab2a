from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry.llm.mixing import flight, flights, land, mix, mix_report, plan_shares, with_tokens


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(1)
    pi = rng.random(300)
    x = np.column_stack([rng.integers(1, 500, 300).astype(float), np.ones(300)])
    moved = flight(pi, x, rng)
    assert ((moved > 0) & (moved < 1)).sum() <= 2 and np.all((moved >= 0) & (moved <= 1))
    assert np.allclose(x.T @ moved, x.T @ pi)


def test_flight_is_unbiased():
    pi = np.array([0.2, 0.5, 0.8, 0.5, 0.3, 0.7])
    x = np.column_stack([np.array([1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), np.ones(6)])
    mean = np.mean([flight(pi, x, np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert np.abs(mean - pi).max() < 0.03


def test_degenerate_flights():
    rng = np.random.default_rng(0)
    for values in ([5.0] * 50, [0.0] * 50):
        x = np.column_stack([np.array(values), np.ones(50)])
        moved = flight(np.full(50, 0.5), x, rng)
        assert ((moved > 0) & (moved < 1)).sum() <= 2 and abs(moved.sum() - 25) < 1e-6


def test_blocks_side_by_side():
    rng = np.random.default_rng(3)
    pis = [rng.random(n) for n in (0, 1, 2, 3, 40, 500)]
    for q in (1, 2):
        xs = [np.column_stack([rng.integers(0, 50, len(p)).astype(float), np.ones(len(p))])[:, :q] for p in pis]
        for p, x, moved in zip(pis, xs, flights(pis, xs, rng)):
            assert ((moved > 0) & (moved < 1)).sum() <= q and np.allclose(x.T @ moved, x.T @ p)
    landed = land(pis[-1], np.column_stack([np.arange(500.0), np.ones(500)]), rng)
    assert set(landed) <= {0.0, 1.0} and abs(landed.sum() - pis[-1].sum()) <= 2


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    rows = []
    for i in range(3000):
        # One source has more than a third of all rows.
        source = "hot" if i % 5 < 2 else r.choice(["a", "b", "c", None, "unlisted"])
        rows.append((i, source, r.randint(0, 400)))
    sized = spark.createDataFrame(rows, "record long, source string, tokens long")
    targets = spark.createDataFrame([("hot", 0.3, 2), ("a", 0.3, 3), ("b", 0.05, 1), ("c", 0.3, 2), ("absent", 0.05, 4), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    return sized, targets, rows


def test_shares_are_met(spark, corpus):
    sized, targets, rows = corpus
    shares = plan_shares(sized, targets)
    total = sum(t for _, _, t in rows)
    used = mix(sized, shares, block=20, side=4)
    assert used.groupBy("record").count().where("count > 1").count() == 0
    report = {r.source: r for r in mix_report(used, shares).collect()}
    assert report["absent"].short and report["absent"].mixed_tokens == 0
    assert report["c"].short and report["c"].most_repeats == 2
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    for name in ("hot", "a", "b"):
        r = report[name]
        assert not r.short and abs(r.mixed_tokens - r.target_share * total) <= 800 and r.most_repeats <= r.max_repeats
        documents = sum(1 for x in rows if x[1] == name)
        assert abs(r.mixed_documents - r.wanted_tokens / r.tokens * documents) <= 4
    assert set(report) == {"hot", "a", "b", "c", "absent"}
    again = mix(sized, shares, block=20, side=4)
    assert used.exceptAll(again).count() == 0  # the same seed draws the same documents


def test_empty_and_null(spark, corpus):
    sized, targets, _ = corpus
    assert mix(sized.limit(0), plan_shares(sized.limit(0), targets)).count() == 0
    shares = plan_shares(sized.limit(0), targets)
    assert mix_report(mix(sized.limit(0), shares), shares).count() == 5
    assert plan_shares(sized, targets.limit(0)).count() == 0 and mix(sized, plan_shares(sized, targets.limit(0))).count() == 0
    odd = spark.createDataFrame([("a", None, 2), ("a", 0.1, None), ("b", -0.0, 0)], "source string, target_share double, max_repeats int")
    assert {s.source: s.max_repeats for s in plan_shares(sized, odd).collect()} == {"a": 0, "b": 0}
    zero = spark.createDataFrame([(1, "z", 0), (2, "z", 0)], "record long, source string, tokens long")
    assert mix(zero, plan_shares(zero, spark.createDataFrame([("z", 1.0, 2)], "source string, target_share double, max_repeats int"))).count() == 0


def test_what_is_short_is_read_from_the_mix(spark):
    """A mix that leaves documents out makes no source short, however little it gives."""
    sized = spark.createDataFrame([(i, "s", 10) for i in range(10)] + [(i, None, 10) for i in range(10, 100)], "record long, source string, tokens long")
    shares = plan_shares(sized, spark.createDataFrame([("s", 0.5, 2)], "source string, target_share double, max_repeats int"))
    used = mix(sized, shares)
    assert mix_report(used, shares).first().short and used.agg(F.sum("repeats")).first()[0] == 20
    assert not mix_report(used.where("record > 3"), shares).first().short
    assert mix(sized, spark.createDataFrame(shares.collect(), shares.schema), seed=4).count() == 10


def test_tokens(spark):
    df = spark.createDataFrame([(1, "s", "hello world"), (2, None, None), (3, "s", ""), (4, "s", "<|endoftext|>"), (4, "s", "long " * 50_000)], "doc_id long, source string, text string")
    got = [(r.record, r.tokens) for r in with_tokens(df.withColumn("tokens", F.lit("clash")), "doc_id", "text", "source").collect()]
    assert got[:3] == [(1, 2), (2, 0), (3, 0)] and got[3][1] > 1 and got[4][1] >= 50_000
