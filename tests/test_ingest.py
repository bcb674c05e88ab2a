from __future__ import annotations

import json

import pytest

from fathomry.operators.chunking import ChunkingConfig
from fathomry.operators.ingest import Corpus
from fathomry.sources import jsonl
from fathomry.sources.files import parse_files, scan_distributed, scan_folder
from fathomry.sources.store import VersionedTable, check_dimension
from fathomry.streaming.ingest import feedback_counts, stream_ingest


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("# Title\n\nsome words here\n\n## Sub\n\nmore words\n")
    (root / "sub" / "b.txt").write_text("plain text")
    (root / "c.pdf").write_text("x")
    (root / "bad.json").write_bytes(b"\xff\xfe")
    (root / ".hidden.yml").write_text("k: v")
    (root / "empty.md").write_text("")
    return root


def counts(row):
    return {k: v for k, v in row.asDict().items() if v}


def test_scan_and_parse(spark, folder):
    found = {r.file_name: r for r in parse_files(scan_folder(spark, str(folder))).collect()}
    assert set(found) == {"a.md", "b.txt", "c.pdf", "bad.json", ".hidden.yml", "empty.md"}
    assert found["a.md"].title == "Title" and found["b.txt"].title is None
    assert found["c.pdf"].skipped == "unsupported extension '.pdf'" and found["c.pdf"].text is None
    assert found["bad.json"].error == "not valid UTF-8"
    assert scan_folder(spark, str(folder / "none")).count() == 0
    assert scan_distributed(spark, str(folder)).count() == 4


def test_life_of_a_corpus(spark, folder, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "store"), ChunkingConfig(50, 100, 0))
    scan = lambda: parse_files(scan_folder(spark, str(folder)))
    dry = corpus.ingest(scan(), "2025-01-01", dry_run=True).first()
    assert dry.n_ingested == 3 and corpus.documents.read().count() == 0
    assert counts(corpus.ingest(scan(), "2025-01-01", str(folder), "p", ("t",)).first()) == {"n_files": 6, "n_skipped": 1, "n_errored": 1, "n_empty": 1, "n_ingested": 3, "n_chunks": 4}
    assert corpus.chunks.read().count() == corpus.vectors.read().count() == 4
    chunk = corpus.chunks.read().where("array_contains(heading_path, 'Sub')").first()
    assert chunk.metadata["title"] == "Title" and chunk.metadata["char_length"] == "10"
    assert counts(corpus.ingest(scan(), "2025-01-02", str(folder)).first()) == {"n_files": 6, "n_skipped": 1, "n_errored": 1, "n_empty": 1, "n_unchanged": 3}
    (folder / "a.md").write_text("")
    (folder / "sub" / "b.txt").unlink()
    assert counts(corpus.ingest(scan(), "2025-01-03", str(folder)).first()) == {"n_files": 5, "n_skipped": 1, "n_errored": 1, "n_empty": 2, "n_unchanged": 1, "n_deleted": 1}
    state = {r.file_name: (r.status, r.deleted_at is not None) for r in corpus.documents.read().collect()}
    assert state == {"a.md": ("Modified", False), "b.txt": ("Deleted", True), ".hidden.yml": ("Active", False)}
    assert corpus.chunks.read().count() == 1
    (folder / "sub" / "b.txt").write_text("plain text")
    assert corpus.ingest(scan(), "2025-01-04", str(folder)).first().n_ingested == 1
    assert {r.file_name: r.status for r in corpus.documents.read().collect()}["b.txt"] == "Active"
    assert corpus.ingest(scan(), "2025-01-05", str(folder), force=True).first().n_ingested == 2


def test_streamed_ingestion(spark, folder, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "store"), ChunkingConfig(50, 100, 0))
    for expected in (2, 3):
        stream_ingest(spark, str(folder), corpus, str(tmp_path / "progress")).awaitTermination()
        assert corpus.documents.read().where("status = 'Active'").count() == expected
        (folder / "new.md").write_text("# New\n\ntext")


def test_store(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "t"), "k string, g string, v int", "k")
    assert store.read().count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "k string, g string, v int")
    values = lambda: sorted((r.k, r.v) for r in store.read().collect())
    store.insert_new(rows(("a", "x", 1), ("b", "x", 2)))
    for bad in (rows(("c", "x", 1), ("c", "x", 1)), rows(("d", "x", 1), ("a", "x", 1))):
        with pytest.raises(ValueError):
            store.insert_new(bad)
    assert values() == [("a", 1), ("b", 2)]
    store.upsert(rows(("a", "y", 5), ("c", "y", 6)))
    store.replace(rows(("b", "x", 9), ("b", "x", 8)), rows(("a", "", 0), ("b", "", 0)))
    assert values() == [("b", 8), ("b", 9), ("c", 6)]
    assert store.compact() and values() == [("b", 8), ("b", 9), ("c", 6)]
    store.delete(rows(("b", "", 0)))
    assert values() == [("c", 6)]


def test_two_writers_lose_nothing(spark, tmp_path):
    make = lambda: VersionedTable(spark, str(tmp_path / "t"), "k string, v int", "k")
    first, second = make(), make()
    calls = []

    def change(state, now):
        calls.append(state["version"])
        if len(calls) == 1:
            # Between this writer's reading and its commit another one commits.
            second.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"))
        return now.selectExpr("k", "v + 1 as v").union(spark.createDataFrame([("c", 0)], "k string, v int")), None, {}

    first.commit(change)
    assert calls == [0, 1] and sorted((r.k, r.v) for r in make().read().collect()) == [("a", 2), ("b", 2), ("c", 0)]
    assert not first.commits.create({"version": 1})


def test_many_changes_are_compacted(spark, tmp_path, monkeypatch):
    from fathomry.sources import store as module

    monkeypatch.setattr(module, "COMPACT_AT", 3)
    store = VersionedTable(spark, str(tmp_path / "t"), "k string, v int", "k")
    for i in range(4):
        store.upsert(spark.createDataFrame([("same", i), (f"k{i}", i)], "k string, v int"))
    assert len(store.commits.newest()["changes"]) == 1
    assert sorted((r.k, r.v) for r in store.read().collect()) == [("k0", 0), ("k1", 1), ("k2", 2), ("k3", 3), ("same", 3)]


def test_dimension_guard(spark):
    good = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert check_dimension(good, "v", 2).count() == 1
    with pytest.raises(Exception, match="another length"):
        check_dimension(spark.createDataFrame([([1.0],)], "v array<double>"), "v", 2).collect()


def test_json_sources(spark, tmp_path):
    assert jsonl.read_log(spark, str(tmp_path / "none")).count() == 0
    log = tmp_path / "log.jsonl"
    log.write_text('{"retrievalRunId":"r","queryId":"q","results":[{"rank":1,"chunkId":"c"}]}\n\n')
    assert jsonl.read_log(spark, str(log)).first().results[0].chunkId == "c"
    log.write_text("{broken\n")
    with pytest.raises(Exception):
        jsonl.read_log(spark, str(log)).collect()
    log.write_text('{"queryId":"q"}\n\n{"queryId":"r"}\n{broken\n[1]\n')
    assert [(r.line, r.text) for r in jsonl.malformed_lines(spark, str(log)).orderBy("line").collect()][:1] == [(4, "{broken")]
    with pytest.raises(ValueError, match="line 4 of"):
        jsonl.read_log(spark, str(log), check=True)
    jsonl.append_log(spark.createDataFrame([("a", None)], "x string, y string"), str(tmp_path / "out"))
    jsonl.append_log(spark.createDataFrame([("b", "c")], "x string, y string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    sets = tmp_path / "q.json"
    sets.write_text(json.dumps([{"id": "1", "question": "what", "expectedChunkIds": ["c"]}]))
    assert jsonl.load_questions(spark, str(sets)).first().expected_source_files == []
    for bad in ("[]", json.dumps([{"id": "1", "question": "what"}])):
        sets.write_text(bad)
        with pytest.raises(ValueError):
            jsonl.load_questions(spark, str(sets))
    jsonl.write_report(spark.createDataFrame([(1, 0.5)], "question_count int, hit_at_1 double"), str(tmp_path / "r" / "x.json"))
    assert json.loads((tmp_path / "r" / "x.json").read_text()) == {"questionCount": 1, "hitAt1": 0.5}


def test_feedback_windows_from_a_stream(spark, tmp_path):
    rows = spark.sql("select * from values ('1', timestamp'2025-01-01 10:05:00', 'vector', 'good'), ('1', timestamp'2025-01-01 10:05:00', 'vector', 'good'), ('2', timestamp'2025-01-01 10:50:00', 'vector', 'bad') t(id, created_at, search_mode, rating)")
    rows.write.parquet(str(tmp_path / "fb"))
    stream = feedback_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "fb")))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert [(r.good_count, r.bad_count) for r in spark.table("windows").collect()] == [(1, 1)]
