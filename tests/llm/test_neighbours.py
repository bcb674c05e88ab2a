from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from fathomry.llm.neighbours import Code, _blocks, default_pivots, default_probes, most_similar, shelve, unit

SCHEMA = "chunk_id string, vector array<float>, arrived_at int, item string, num int, packed string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x") for r in rows], SCHEMA)


def neighbours(df, **options):
    out = {}
    for r in most_similar(df, dimension=8, **options).collect():
        out.setdefault(r.item, {})[r.other] = r.cosine
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    x = (centres[np.minimum(rng.integers(0, 30, 1500), 11)] + 0.5 * rng.normal(size=(1500, 8))) * rng.uniform(0.1, 9, (1500, 1))
    return x.astype(np.float32)


def test_recall(spark, cloud):
    rows = [(f"c{i:05}", v.tolist(), 1) for i, v in enumerate(cloud)]
    got = neighbours(frame(spark, rows), k=10, probes=20)
    x = unit(cloud).astype(float)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    hits = sum(len({f"c{j:05}" for j in np.argsort(-s[i])[:10]} & set(got[f"c{i:05}"])) for i in range(len(x)))
    assert hits / (10 * len(x)) >= 0.9
    a, b = "c00003", next(iter(got["c00003"]))
    assert got[a][b] == pytest.approx(s[3, int(b[1:])], abs=1e-6)
    assert all(len(v) == 10 and i not in v for i, v in got.items())


def test_exact_with_all_files(spark, cloud):
    rows = [(f"c{i:05}", v.tolist(), 1) for i, v in enumerate(cloud[:300])]
    got = neighbours(frame(spark, rows), k=5, pivots=10, probes=10)
    x = unit(cloud[:300]).astype(float)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    assert all(set(got[f"c{i:05}"]) == {f"c{j:05}" for j in np.argsort(-s[i])[:5]} for i in range(300))


def test_many_shelves_and_blocks_give_the_same(spark, cloud, monkeypatch):
    from fathomry.llm import neighbours as module

    rows = [(f"c{i:05}", v.tolist(), 1) for i, v in enumerate(cloud[:400])]
    whole = neighbours(frame(spark, rows), k=5, pivots=20, probes=6)
    monkeypatch.setattr(module, "BLOCK", 60)
    monkeypatch.setattr(module, "CELLS", 500)
    cut = neighbours(frame(spark, rows), k=5, pivots=20, probes=6)
    assert {i: {j: round(c, 5) for j, c in x.items()} for i, x in cut.items()} == {i: {j: round(c, 5) for j, c in x.items()} for i, x in whole.items()}


def test_dirty_vectors_and_copies(spark):
    one = [1.0] + [0.0] * 7
    two = [0.0, 1.0] + [0.0] * 6
    bad = [("n", None), ("e", []), ("s", [1.0]), ("z", [0.0] * 8), ("nan", [float("nan")] + one[1:]), ("inf", [float("inf")] + one[1:]), (None, one)]
    copies = [(f"k{i:03}", one, 1) for i in range(60)]
    rows = [(i, v, 1) for i, v in bad] + copies + copies[:5] + [("a", two, 1), ("a", one, 2), ("m", [1.0, 1.0] + [0.0] * 6, 1), ("neg", [-0.0, 1.0] + [0.0] * 6, 1)]
    got = neighbours(frame(spark, rows), k=3)
    assert set(got) == {c[0] for c in copies} | {"a", "m", "neg"}
    assert set(got["k000"]) == {"k001", "k002", "k003"} and set(got["k059"]) == {"k000", "k001", "k002"}
    assert got["a"]["neg"] == 1.0 and "m" in got["a"]
    assert got["m"].keys() == {"a", "k000", "k001"}  # all as near: the smallest ids win
    assert most_similar(frame(spark, []), dimension=8).count() == 0
    assert most_similar(frame(spark, [("only", one, 1)]), dimension=8).count() == 0


def test_disk_does_not_grow_with_what_queries_look_into(spark, tmp_path, monkeypatch):
    from fathomry.llm import neighbours as module
    from fathomry.session import shared_dir

    rng = np.random.default_rng(6)
    x = rng.normal(size=(12_000, 64)).astype(np.float16).astype(np.float32)
    spark.createDataFrame([(f"chunk_{v:016x}", x[i].tolist(), 1) for i, v in enumerate(rng.integers(0, 2**62, len(x)))], "chunk_id string, vector array<float>, arrived_at int").coalesce(2).write.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(module, "BLOCK", 500)
    monkeypatch.setattr(module, "SAMPLE", 256)
    scala = spark.sparkContext._jsc.sc()

    def written():
        scala.listenerBus().waitUntilEmpty()
        files = sum(f.stat().st_size for f in Path(shared_dir(spark).removeprefix("file:")).rglob("*") if f.is_file())
        return files + scala.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = written()
    found = most_similar(spark.read.parquet(f"{tmp_path}/in"), pivots=96, probes=48).count()
    assert found == 120_000
    assert written() - before <= 4 * sum(f.stat().st_size for f in (tmp_path / "in").iterdir())


def test_few_vectors_that_count(spark):
    rows = [(f"b{i:05}", [float(i), 1.0], 1) for i in range(9000)] + [(f"c{i}", [1.0] * 7 + [float(i)], 1) for i in range(3)]
    assert {i: len(v) for i, v in neighbours(frame(spark, rows), k=5).items()} == {"c0": 2, "c1": 2, "c2": 2}


def test_values_as_bytes():
    lists = pa.array([[1.5, -2.0], None, [-0.0, 3.0], [0.0], [float("nan"), 1.0], [None, 1.0], [-float("inf"), 1.0], []], pa.list_(pa.float32()))
    for code in (Code(2, 2), Code(2, 4)):
        packed = code.pack(lists)
        order = [lists[i].as_py() for i in sorted((i for i in range(8) if i != 1), key=lambda i: packed[i].as_py())]
        assert str(order) == str([[], [None, 1.0], [-float("inf"), 1.0], [0.0], [-0.0, 3.0], [1.5, -2.0], [float("nan"), 1.0]]) and packed[1].as_py() is None
        batch, rows = next(code.count([pa.RecordBatch.from_arrays([packed], ["packed"])]))
        assert rows.tolist() == [[1.5, -2.0], [0.0, 3.0]] and batch.num_rows == 2
        assert code.unpack(packed.slice(2, 1)).tolist() == [[0.0, 3.0]]


def test_wide_values_keep_their_precision(spark, cloud):
    rows = [(f"c{i}", v, 1) for i, v in enumerate([[1.0, 1e-6] + [0.0] * 6, [1.0] + [0.0] * 7, [1e30, 3e24] + [0.0] * 6])]
    got = neighbours(frame(spark, rows), k=2)
    assert got["c0"]["c1"] == pytest.approx(1 - 5e-13, abs=1e-15) and got["c1"]["c2"] == pytest.approx(1 - 4.5e-12, abs=1e-15)


def test_parts():
    assert _blocks(np.array([5, 0, 3, 25, 4, 4, 4]), 10) == [[(0, 0, 1), (2, 0, 1)], [(3, 0, 3)], [(3, 1, 3)], [(3, 2, 3)], [(4, 0, 1), (5, 0, 1)], [(6, 0, 1)]]
    groups = shelve(np.random.default_rng(0).normal(size=(100, 4)), 24)
    assert sorted(np.concatenate(groups).tolist()) == list(range(100)) and max(map(len, groups)) <= 24
    assert default_pivots(0) == 8 and default_probes(8, 0) == default_probes(8, 100) == 8 and default_probes(1000, 10**6) == 76
