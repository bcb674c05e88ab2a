from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from fathomry.session import local_session

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4, "tests", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__driver__memory="4g", spark__sql__shuffle__partitions="4",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


@pytest.fixture(scope="session")
def against_sql(spark):
    """Compare a registered query with its SQL on the smallest test tables."""
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view \"{path.stem}\" as select * from read_parquet('{path}')")

    def compare(query, sql):
        df = query(spark, str(DATA))
        columns = sorted(df.columns)
        mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
        rel = con.execute(sql)
        heads = [d[0] for d in rel.description]
        assert sorted(heads) == columns
        assert sorted(tuple(plain(r[heads.index(c)]) for c in columns) for r in rel.fetchall()) == mine

    return compare
