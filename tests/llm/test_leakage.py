from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomry.llm.leakage import gram_hashes, leaks, longest_run, tokens, winnow


def brute(docs, items, shared):
    out = {}
    for d, t in docs:
        a = tokens(t)
        for i, u in items:
            b = tokens(u)
            best = max((longest_run(a, b, g)[0] for g in range(-len(b), len(a))), default=0)
            if best >= shared:
                out[d, i] = best
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=40), st.lists(st.sampled_from("ab"), max_size=40), st.lists(st.sampled_from("abc"), min_size=12, max_size=20))
def test_every_shared_span_leaves_a_fingerprint(before, after, span):
    def kept(words):
        h = gram_hashes(words, 5)
        return set(h[winnow(h, 8)].tolist())

    assert kept(before + span) & kept(span + after)


def test_short_texts():
    assert len(gram_hashes(["a"] * 4, 5)) == 0 and len(winnow(np.empty(0, np.uint64), 8)) == 0
    assert len(winnow(gram_hashes(["a"] * 5, 5), 8)) == 1
    assert tokens(None) == tokens("") == tokens("é!") == [] and tokens(chr(0x212A) + "Ab-1") == ["ab", "1"]


def test_brute_force(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(words, k=r.randint(5, 60)))) for i in range(12)] + [(90, None), (91, ""), (92, "x " * 40)]
    docs = []
    for d in range(80):
        text = r.choices(words, k=r.randint(0, 80))
        if d % 2:
            source = items[r.randrange(12)][1].split()
            n = r.randint(8, 16)
            at = r.randrange(max(1, len(source) - n))
            p = r.randrange(len(text) + 1)
            text[p:p] = [w.upper() for w in source[at : at + n]]
        docs.append((d, ", ".join(text)))
    docs += [(200, docs[1][1]), (201, None), (202, ""), (203, "x " * 5000), (204, "lorem " * 30_000 + items[0][1])]
    df = spark.createDataFrame([(d, t, 1, 1, 1) for d, t in docs], "doc_id long, text string, item_id int, fp int, pos int")
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {(x.doc_id, x.item_id): x for x in leaks(df, it).collect()}
    # Looked up in many parts, the items give the same.
    assert {(x.doc_id, x.item_id): x for x in leaks(df, it, part=300).collect()} == got
    plan = leaks(df, it)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    expected = brute([x for x in docs if x[0] not in (203, 204)], items, 12) | {(203, 92): 40}
    expected[204, 0] = len(items[0][1].split())
    assert {k: x.shared_words for k, x in got.items() if k[1] != 92 or k[0] == 203} == expected
    for (d, i), x in got.items():
        a, b = tokens(dict(docs)[d]), tokens(dict(items)[i])
        assert a[x.doc_start : x.doc_start + x.shared_words] == b[x.item_start : x.item_start + x.shared_words]
    assert leaks(df.limit(0), it).count() == 0 == leaks(df, it.limit(0)).count()
