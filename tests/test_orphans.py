from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fathomry.operators.orphans import Child, Parent, orphan_report, orphans

T = [dt.datetime(2025, m, 1) for m in range(1, 9)]
DOC = "id string, v int, status string, at timestamp, ref_key string, parent string"
REF = "rec string, doc string, at timestamp, salt int, known string"


def run(spark, docs, refs, alive=True, **options):
    d = spark.createDataFrame([(*r, "x", "y") for r in docs], DOC)
    c = spark.createDataFrame([(*r, 1, "k") for r in refs], REF)
    return orphans([Parent("d", d, "id", "at", "v", F.col("status") == "Deleted")], [Child("r", "doc", "d", c, "rec", F.col("doc"), "at", alive=alive)], **options)


def as_set(df):
    return {(r.record_id, r.ref_key, r.reason) for r in df.collect()}


def test_reasons(spark):
    docs = [("a", 1, "Active", T[0]), ("late", 1, "Active", T[5]), ("gone", 1, "Active", T[0]), ("gone", 2, "Deleted", T[1]), ("back", 2, "Active", T[1]), ("back", 1, "Deleted", T[0]), (None, 1, "Active", T[0])]
    refs = [("1", "a", T[2]), ("2", "late", T[2]), ("3", "gone", T[2]), ("4", "back", T[2]), ("5", "none", T[2]), ("6", "", T[2]), ("7", None, T[2]), ("8", "late", T[6]), ("8", "late", T[6]), ("9", "late", T[7]), ("9", "late", T[1]), (" a", " a", T[3])]
    assert as_set(run(spark, docs, refs)) == {("2", "late", "late"), ("3", "gone", "deleted"), ("5", "none", "missing"), ("6", "", "missing"), ("9", "late", "late"), (" a", " a", "missing")}
    assert ("3", "gone", "deleted") not in as_set(run(spark, docs, refs, alive=False))


def test_empty_tables(spark):
    assert run(spark, [], []).count() == 0
    assert as_set(run(spark, [], [("1", "a", T[0])])) == {("1", "a", "missing")}
    assert run(spark, [("a", 1, "Active", T[0])], []).count() == 0


def test_null_arrivals(spark):
    assert as_set(run(spark, [("a", 1, "Active", None)], [("1", "a", T[0])])) == {("1", "a", "missing")}
    assert as_set(run(spark, [("a", 1, "Active", T[0])], [("1", "a", None)])) == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    r = random.Random(seed)
    # One key has a third of all references.
    docs = [(f"d{r.randint(0, 9)}", v, r.choice(["Active", "Deleted"]), r.choice(T)) for v in range(30)]
    refs = [(str(r.randint(0, 60)), "d0" if r.random() < 0.3 else f"d{r.randint(0, 14)}", r.choice(T)) for _ in range(200)]
    expected = set()
    for rec, key in {(a, b) for a, b, _ in refs}:
        at = min(t for a, b, t in refs if (a, b) == (rec, key))
        rows = [d for d in docs if d[0] == key]
        if not any(d[3] <= at for d in rows):
            expected.add((rec, key))
        elif max(rows, key=lambda d: d[1])[2] == "Deleted":
            expected.add((rec, key))
    assert {(a, b) for a, b, _ in as_set(run(spark, docs, refs))} == expected


def test_lists_of_keys_and_report(spark):
    c = spark.createDataFrame([("1", ["a", None, "b", "b"], T[0]), ("1", ["a", None, "b", "b"], T[1]), ("2", [], T[0]), ("3", None, T[1])], "rec string, keys array<string>, at timestamp")
    d = spark.createDataFrame([("a", T[0])], "id string, at timestamp")
    found = orphans([Parent("d", d, "id", "at")], [Child("r", "keys", "d", c, "rec", F.col("keys"), "at")])
    assert as_set(found) == {("1", "b", "missing")}
    report = orphan_report(found).collect()
    assert [(r.month, r.n_references, r.n_records) for r in report] == [("2025-01", 1, 1)]


def test_hot_keys_are_spread(spark):
    refs = [(str(i), "none" if i % 3 else f"k{i % 5}", T[2]) for i in range(60)]
    docs = [("k0", 1, "Active", T[0])]
    found = run(spark, docs, refs, hot=7)
    assert as_set(found) == {(r, k, "missing") for r, k, _ in refs if k != "k0"} and found.count() == len(as_set(found))
