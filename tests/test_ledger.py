from __future__ import annotations

import datetime as dt
import random
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from fathomry.operators.ledger import StaleToken, WorkLedger, replay, run_table

T = [dt.datetime(2025, 1, 1) + dt.timedelta(days=i) for i in range(40)]
Run = namedtuple("Run", "number run_id started_at status")
ROWS = "id string, v int, at timestamp, h string, status string, item string, slot string"


def history(spark, rows, runs):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], ROWS)
    log = spark.createDataFrame([tuple(r) for r in runs], "run_no int, run_id string, started_at timestamp, run_status string")
    return replay(df, log, "id", "v", "at", "h", F.col("status") == "Deleted")


def brute(rows, runs):
    out, previous = set(), {}
    for run in runs:
        if run.status != "succeeded":
            continue
        state = {}
        for key in {r[0] for r in rows if r[0]}:
            seen = [r for r in rows if r[0] == key and r[2] <= run.started_at]
            if seen:
                best = max(seen, key=lambda r: r[1])
                if best[4] != "Deleted":
                    state[key] = best[3]
        out |= {(run.run_id, k) for k in {*state, *previous} if state.get(k) != previous.get(k)}
        previous = state
    return out


@pytest.mark.parametrize("seed", range(4))
def test_replay_is_exact(spark, seed):
    r = random.Random(seed)
    runs = [Run(i, f"r{i}", T[4 * i + 2], r.choice(["succeeded", "succeeded", "failed", "running"])) for i in range(9)]
    rows = []
    for v in range(80):
        row = (f"d{r.randint(0, 9) if r.random() < 0.7 else 0}", v, r.choice(T), r.choice("xyz"), r.choice(["Active", "Active", "Deleted"]))
        rows += [row] * r.randint(1, 2)
        if r.random() < 0.3:
            rows.append((*row[:2], T[-1], *row[3:]))
    done = {(x.run_id, x.item) for x in history(spark, rows, runs).where("state = 'done'").collect()}
    assert done == brute(rows, runs)


def test_failed_runs_leave_leases_that_expire(spark):
    runs = [Run(1, "a", T[1], "failed"), Run(2, "b", T[2], "succeeded"), Run(3, "c", T[3], "running")]
    rows = [("d", 1, T[0], "x", "Active"), ("d", 2, T[2], "y", "Active"), ("e", 1, T[2], "x", "Active")]
    got = {(x.item, x.run_id, x.state, x.value, x.token) for x in history(spark, rows, runs).collect()}
    # Arrived at the very start of run b: b takes it.
    assert got == {("d", "a", "expired", "x", 1), ("d", "b", "done", "y", 2), ("e", "b", "done", "x", 2)}
    paths = history(spark, rows, runs).select("path").distinct().count()
    assert paths == 3


def test_undone_changes_are_no_work(spark):
    runs = [Run(1, "a", T[1], "succeeded"), Run(2, "b", T[3], "failed"), Run(3, "c", T[5], "succeeded")]
    rows = [("d", 1, T[0], "x", "Active"), ("d", 2, T[2], "y", "Active"), ("d", 3, T[4], "x", "Active")]
    got = [(x.run_id, x.state) for x in history(spark, rows, runs).orderBy("token").collect()]
    assert got == [("a", "done"), ("b", "expired")]


def test_nulls_and_empty(spark):
    runs = [Run(1, "a", T[1], "succeeded")]
    rows = [(None, 1, T[0], "x", "Active"), ("d", None, T[0], "x", "Active"), ("e", 1, None, "x", "Active"), ("f", 1, T[0], None, "Active"), ("g", 1, T[0], "x", None)]
    assert [x.item for x in history(spark, rows, runs).collect()] == ["g"]
    assert history(spark, [], runs).count() == 0 and history(spark, rows, []).count() == 0
    log = spark.createDataFrame([(1, "a", T[1], "succeeded"), (2, "b", T[0], None), (3, None, T[0], "failed"), (4, "d", None, "failed")], "run_no int, run_id string, started_at timestamp, run_status string")
    assert [(r.run_id, r.status, r.next_done, r.last) for r in run_table(log).orderBy("at").collect()] == [("b", "running", 1, False), ("a", "succeeded", 1, True)]


def test_durable_ledger(spark, tmp_path):
    book = WorkLedger(spark, str(tmp_path / "ledger"))
    want = lambda *rows: spark.createDataFrame(list(rows), "item string, value string")
    first = {(r.item, r.value) for r in book.lease(want(("a", "1"), ("b", "1")), 1, T[0], T[2]).collect()}
    assert first == {("a", "1"), ("b", "1")}
    # Held by run 1 until it expires; only the new item is free.
    assert [r.item for r in book.lease(want(("a", "2"), ("b", "1"), ("c", "1")), 2, T[1], T[5]).collect()] == ["c"]
    with pytest.raises(StaleToken):
        book.lease(want(("a", "1")), 2, T[1], T[5])
    with pytest.raises(StaleToken):
        book.complete(1, T[3])  # too late
    taken = book.lease(want(("a", "2"), ("b", "1"), ("c", "1")), 3, T[3], T[6])
    again = {(r.item, r.value): r.path for r in taken.collect()}
    assert set(again) == {("a", "2"), ("b", "1")}
    with pytest.raises(StaleToken):
        book.complete(1, T[3])
    book.complete(2, T[4])
    book.complete(3, T[4])
    assert {(r.item, r.state, r.done.value) for r in book.rows().collect()} == {("a", "done", "2"), ("b", "done", "1"), ("c", "done", "1")}
    # Nothing changed: nothing to do. Then one is gone and one changed.
    assert book.lease(want(("a", "2"), ("b", "1"), ("c", "1")), 4, T[7], T[9]).count() == 0
    left = {(r.item, r.value) for r in book.lease(want(("a", "2"), ("b", "9")), 5, T[7], T[9]).collect()}
    assert left == {("b", "9"), ("c", None)}
    book.release(5)
    assert {(r.item, r.value) for r in book.lease(want(("a", "2"), ("b", "9")), 6, T[8], T[9]).collect()} == left
    book.complete(6, T[8])
    assert {r.item: r.done.value for r in book.rows().collect()} == {"a": "2", "b": "9", "c": None}


def test_a_writer_that_dies_leaves_the_ledger_as_it_was(spark, tmp_path):
    book = WorkLedger(spark, str(tmp_path / "ledger"))
    book.lease(spark.createDataFrame([("a", "1")], "item string, value string"), 1, T[0], T[2])
    broken = tmp_path / "ledger" / "ledger" / "data" / "half"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    (tmp_path / "ledger" / "ledger" / "commits" / "draft-x").write_text("{")
    assert [r.item for r in book.rows().collect()] == ["a"]
    book.complete(1, T[1])
    assert book.rows().first().state == "done"


@pytest.mark.parametrize("later", [2, 1])
def test_interleaved_leases(spark, tmp_path, later):
    """Another run commits after this one has read the ledger: a newer token takes all, an older one leaves the rest."""
    rows = spark.createDataFrame([("a", "1"), ("b", "1")], "item string, value string")
    mine, other = WorkLedger(spark, str(tmp_path / "l")), WorkLedger(spark, str(tmp_path / "l"))
    create, got = mine.table.commits.create, []

    def slow(record):
        if not got:
            got.append([r.item for r in other.lease(rows.where("item = 'a'"), later, T[0], T[9], whole=False).collect()])
        return create(record)

    mine.table.commits.create = slow
    if later == 2:
        with pytest.raises(StaleToken):
            mine.lease(rows, 1, T[0], T[9])
        assert mine.newest_token() == 2
    else:
        assert [r.item for r in mine.lease(rows, 2, T[0], T[9]).collect()] == ["b"]
        assert {(r.item, r.token) for r in mine.rows().collect()} == {("a", 1), ("b", 2)}
    assert got == [["a"]]


def test_only_changes_are_offered(spark, tmp_path):
    book = WorkLedger(spark, str(tmp_path / "l"))
    want = lambda *rows: spark.createDataFrame(list(rows), "item string, value string")
    book.lease(want(("a", "1"), ("b", "1")), 1, T[0], T[2], whole=False)
    book.complete(1, T[1])
    book.lease(want(("c", "1")), 2, T[1], T[3], whole=False)
    # Run 2 died. Run 3 is told of one change and one deletion, and takes over what was left.
    left = {(r.item, r.value) for r in book.lease(want(("b", None), ("a", "1")), 3, T[4], T[6], whole=False).collect()}
    assert left == {("b", None), ("c", "1")}
    with pytest.raises(StaleToken):
        book.complete(2, T[5])
    book.complete(3, T[5])
    assert {r.item: r.done.value for r in book.rows().collect()} == {"a": "1", "b": None, "c": "1"}
