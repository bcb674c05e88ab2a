from __future__ import annotations

import datetime as dt
import math
import random
from itertools import combinations

import pytest

from fathomry.llm.idealpoint import distinct_items, ideal_point_ranking, one_sided_groups

T = dt.datetime(2025, 1, 1)
ROWS = "run string, chunk string, at timestamp, rank int, v float, k float, grp string, item string"


def items(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], ROWS)
    return distinct_items(df, "run", "chunk", "at", ["rank", "v", "k"])


def topsis(rows):
    """rows: (item, v, k)."""
    ranks = {}
    columns = []
    for j in (1, 2):
        values = sorted(r[j] for r in rows if r[j] is not None and math.isfinite(r[j]))
        if not values:
            columns.append([0.0] * len(rows))
            continue
        low, high = (values[max(0, math.ceil(p * len(values)) - 1)] for p in (0.05, 0.95))
        x = [low if r[j] is None or not math.isfinite(r[j]) else min(high, max(low, r[j])) for r in rows]
        size = math.sqrt(sum(a * a for a in x))
        columns.append([a / size if size else 0.0 for a in x])
    for i, r in enumerate(rows):
        best = math.sqrt(sum((0.5 * (c[i] - max(c))) ** 2 for c in columns))
        worst = math.sqrt(sum((0.5 * (c[i] - min(c))) ** 2 for c in columns))
        ranks[r[0]] = worst / (best + worst) if best + worst > 0 else 1.0
    return ranks


def test_brute_force(spark):
    r = random.Random(2)
    rows = [(f"g{g}", f"c{i}", T, i, r.random(), r.choice([None, 1000 * r.random(), 3.0])) for g in range(12) for i in range(g + 1)]
    rows += r.choices(rows, k=30) + [(None, "c", T, 1, 1.0, 1.0), ("g1", None, T, 1, 1.0, 1.0)]
    got = ideal_point_ranking(items(spark, rows), ["v", "k"]).collect()
    import numpy as np

    for g in range(12):
        mine = {x.item: x for x in got if x.grp == f"g{g}"}
        once = {x[1]: (x[1], float(np.float32(x[4])), None if x[5] is None else float(np.float32(x[5]))) for x in rows if x[0] == f"g{g}" and x[1]}
        expected = topsis([once[c] for c in sorted(once)])
        assert {c: round(x.closeness, 9) for c, x in mine.items()} == {c: round(v, 9) for c, v in expected.items()}
        assert sorted(mine, key=lambda c: mine[c].ideal_rank) == sorted(expected, key=lambda c: (-mine[c].closeness, c))


def test_no_score_drowns_the_other(spark):
    rows = [("g", "a", T, 1, 0.9, 10.0), ("g", "b", T, 2, 0.8, 9000.0), ("g", "c", T, 3, 0.1, 9100.0)]
    ranked = ideal_point_ranking(items(spark, rows), ["v", "k"], lower=0.0, upper=1.0).orderBy("ideal_rank").collect()
    assert ranked[0].item == "b"


def test_degenerate_groups(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("one", "a", T, 1, 0.5, 0.5), ("same", "b", T, 1, 1.0, 1.0), ("same", "a", T, 2, 1.0, 1.0), ("none", "a", T, 1, None, None), ("none", "b", T, 2, None, nan), ("zero", "a", T, 1, 0.0, 0.0), ("inf", "a", T, 1, inf, 1.0), ("inf", "b", T, 2, 0.5, 1.0)]
    got = {(x.grp, x.item): (x.closeness, x.ideal_rank) for x in ideal_point_ranking(items(spark, rows), ["v", "k"]).collect()}
    assert all(c == 1.0 for c, _ in got.values())
    assert got["same", "a"][1] == 1 and got["none", "b"][1] == 2
    assert ideal_point_ranking(items(spark, []), ["v", "k"]).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_sided_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for g in range(60):
        n = r.randint(3, 14)
        falling = sorted((r.randint(0, 40) / 8 for _ in range(n)), reverse=True) if g % 4 == 0 else sorted((i + r.random() for i in range(n)), reverse=True)
        other = [r.randint(0, 9) / 1.0 for _ in range(n)]
        if g % 5 == 0:
            other.sort(reverse=True)
        a, b = (falling, other) if g % 2 else (other, falling)
        for i in range(n):
            rows.append((f"g{g}", f"c{i:02}", T, i + 1, a[i], None if r.random() < 0.08 else b[i]))
    big = 300
    rows += [("big", f"c{i:04}", T, i, float(-i), float(r.randint(0, 50))) for i in range(big)]
    rows += r.choices(rows, k=100)
    expected = set()
    for g in {x[0] for x in rows}:
        both = sorted({(x[3], x[1], x[4], x[5]) for x in rows if x[0] == g and x[4] is not None and x[5] is not None})
        if len(both) < 5:
            continue
        for lead, other in ((2, 3), (3, 2)):
            if all(p[lead] > q[lead] for p, q in zip(both, both[1:])):
                pairs = list(combinations(both, 2))
                if sum(q[other] > p[other] for p, q in pairs) >= 0.4 * len(pairs):
                    expected.add((g, "v" if lead == 2 else "k"))
    assert expected and ("big", "v") in expected
    # Whatever the size from which groups are spread, the result is the same.
    for hot in (100_000, 100):
        assert {(x.grp, x.leading) for x in one_sided_groups(items(spark, rows), "rank", "v", "k", hot=hot).collect()} == expected


def test_large_groups_rank_the_same(spark):
    r = random.Random(4)
    rows = [(f"g{g}", f"c{i:03}", T, i, r.choice([None, float(r.randint(0, 30)), 1e6 * r.random()]), r.random()) for g in range(3) for i in range(120 * g + 10)]
    def ranked(hot):
        return {(x.grp, x.item): (round(x.closeness, 12), x.ideal_rank) for x in ideal_point_ranking(items(spark, rows), ["v", "k"], hot=hot).collect()}
    assert ranked(100) == ranked(100_000)


def test_the_ranking_decides(spark, monkeypatch):
    """With the operator's scores spoilt, the groups are no longer found."""
    from fathomry.llm import idealpoint

    rows = [("g", f"c{i}", T, i, float(-i), float(i)) for i in range(6)]
    assert one_sided_groups(items(spark, rows), "rank", "v", "k").count() == 1
    whole = idealpoint._ranked
    monkeypatch.setattr(idealpoint, "_ranked", lambda *a: whole(*a).withColumns({"v_n": -idealpoint.F.col("v_n"), "k_n": idealpoint.F.abs(idealpoint.F.col("k_n") - 0.3)}))
    assert one_sided_groups(items(spark, rows), "rank", "v", "k").count() == 0
