from __future__ import annotations

import math
import random
from collections import Counter

from fathomry.llm.distinctive import distinctive_terms

ROWS = "id string, body string, at int, record string, term string, text string, tf int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", 1) for r in rows], ROWS)


def brute(docs, k1=1.2, b=0.75):
    split = {d: "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in t or "").split() for d, t in docs.items()}
    n, average = len(split), sum(map(len, split.values())) / len(split)
    df = Counter(t for words in split.values() for t in set(words))
    out = {}
    for d, words in split.items():
        for t, tf in Counter(words).items():
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            out[d, t] = (tf, df[t], idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / average)))
    return out


def test_brute_force(spark):
    r = random.Random(3)
    docs = {f"c{i}": " ".join(r.choice("Alpha beta gamma, delta-eps Zeta42 é".split()) for _ in range(r.randint(0, 30))) for i in range(40)}
    docs |= {"empty": "", "none": None, "long": "alpha " * 50_000 + "once"}
    rows = [(d, t, 1) for d, t in docs.items()]
    rows += r.choices(rows, k=len(rows)) + [rows[0]] * 60  # repeats, one of them hot
    rows += [(d, "later text is not the record's own", 2) for d in ("c1", "empty")] + [(None, "no record", 1)]
    got = {(x.record, x.term): x for x in distinctive_terms(frame(spark, rows), "id", "body", "at").collect()}
    expected = brute(docs)
    assert set(got) == set(expected)
    for key, (tf, df, score) in expected.items():
        assert (got[key].tf, got[key].df) == (tf, df) and math.isclose(got[key].score, score, rel_tol=1e-9)
    few = {(x.record, x.term) for x in distinctive_terms(frame(spark, rows), "id", "body", "at", min_tf=3, min_df=2, max_df=12).collect()}
    assert few == {k for k, (tf, df, _) in expected.items() if tf >= 3 and 2 <= df <= 12}


def test_hot_terms_are_spread(spark, monkeypatch):
    from fathomry.llm import distinctive

    docs = {f"c{i}": f"the the word{i % 4} own{i}" for i in range(50)}
    rows = [(d, t, 1) for d, t in docs.items()]
    monkeypatch.setattr(distinctive.salted_join, "__defaults__", (5,))
    got = {(x.record, x.term): (x.tf, x.df) for x in distinctive_terms(frame(spark, rows), "id", "body", "at").collect()}
    assert got == {k: v[:2] for k, v in brute(docs).items()}


def test_empty(spark):
    assert distinctive_terms(frame(spark, []), "id", "body", "at").count() == 0
    assert distinctive_terms(frame(spark, [("a", None, 1), ("b", "", None)]), "id", "body", "at").count() == 0
