"""Every core query against its SQL."""

from __future__ import annotations

import pytest

from fathomry.plans import core_registries

REGISTRIES = core_registries()
CHECKED = [(name, r.queries[name], sql) for r in REGISTRIES for name, sql in r.oracles.items()]
UNCHECKED = [(name, q) for r in REGISTRIES for name, q in r.queries.items() if name not in r.oracles]


@pytest.mark.parametrize("name,query,sql", CHECKED, ids=[c[0] for c in CHECKED])
def test_same_as_sql(name, query, sql, against_sql):
    against_sql(query, sql)


@pytest.mark.parametrize("name,query", UNCHECKED, ids=[c[0] for c in UNCHECKED])
def test_runs(name, query, spark):
    from tests.conftest import DATA

    if not DATA.exists():
        pytest.skip("no test tables")
    assert query(spark, str(DATA)).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p2_found", "p6_found", "bm25_topk", "hybrid_rrf"} <= set(entry.queries())


def test_keyword_path_shuffles_only_the_best(spark):
    """Records are scored where they are read: after scoring, only the tasks' best rows are exchanged, and no pair of a query and a record before it."""
    from tests.conftest import DATA

    if not DATA.exists():
        pytest.skip("no test tables")
    plan = next(q for r in REGISTRIES for n, q in r.queries.items() if n == "bm25_topk")(spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Aggregate" not in plan and "Generate" not in plan
