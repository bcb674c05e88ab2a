from __future__ import annotations

import pytest

from fathomry.llm.queries import registry

CHECKED = sorted(registry.oracles)
UNCHECKED = sorted(set(registry.queries) - set(registry.oracles))


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(name, against_sql):
    against_sql(registry.queries[name], registry.oracles[name])


@pytest.mark.parametrize("name", UNCHECKED)
def test_runs(name, spark):
    from tests.conftest import DATA

    if not DATA.exists():
        pytest.skip("no test tables")
    assert registry.queries[name](spark, str(DATA)).columns


def test_found_columns(spark):
    from tests.conftest import DATA

    if not DATA.exists():
        pytest.skip("no test tables")
    expected = {
        "p1_found": ["chunk_id", "term"], "p3_found": ["chunk_a", "chunk_b"], "p4_found": ["chunk_id"], "p5_found": ["retrieval_run_id"], "p7_found": ["chunk_id", "kind"],
        "p8_found": ["doc_id", "item_id"], "p9_found": ["source"], "p10_found": ["doc_id"],
    }
    for name, columns in expected.items():
        assert registry.queries[name](spark, str(DATA)).columns == columns
