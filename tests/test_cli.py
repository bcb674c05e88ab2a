from __future__ import annotations

import json
import re

from fathomry import cli
from fathomry.cli import main
from fathomry.operators.ingest import Corpus


def test_a_whole_session(spark, tmp_path, capsys, monkeypatch):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "arch.md").write_text("# Architecture\n\nlayering rules and component boundaries are important\n")
    (docs / "deploy.md").write_text("# Deploy\n\nrun the deployment script and check the dashboard\n")
    questions = tmp_path / "q.json"
    questions.write_text(json.dumps([{"id": "1", "question": "component boundaries", "expectedSourceFiles": ["arch.md"]}]))

    def run(*arguments):
        code = main(["--store", str(tmp_path / "store"), *arguments], spark)
        return code, capsys.readouterr()

    assert run("spike")[0] == 0
    assert run("search", "x", "--mode", "fuzzy")[0] == 2
    assert run("search", " ", "--mode", "keyword")[0] == 2
    assert "0 results" in run("search", "boundaries", "--mode", "keyword")[1].out
    code, said = run("ingest", str(docs), "--project", "p", "--tag", "t")
    assert code == 0 and json.loads(said.out)["n_ingested"] == 2
    code, said = run("search", "component boundaries", "--mode", "keyword", "--explain", "--project", "p")
    assert "arch.md" in said.out and "keyword #1 of 1" in said.out
    query, chunk = re.search(r"qry_\w+", said.out).group(), re.search(r"chunk_\w+", said.out).group()
    # The stand-in embedding makes a text its own nearest neighbour.
    assert "1. 1.0000" in run("search", "layering rules and component boundaries are important", "--top-k", "1")[1].out
    report = tmp_path / "report.json"
    assert run("eval", str(questions), "--mode", "keyword", "--fail-below-hit-at-3", "0.5", "--report", str(report))[0] == 0
    said = json.loads(report.read_text())
    assert said["metrics"]["hitAt3"] == 1.0 and said["metrics"]["avgLatencyMs"] > 0 and said["status"] == "completed" and said["datasetPath"] == str(questions)
    assert said["embeddingModel"] == {"name": "mock", "dimension": 32} and said["runId"].startswith("evr_")
    assert [(q["questionId"], q["firstRank"], q["questionText"]) for q in said["questionResults"]] == [("1", 1, "component boundaries")]
    code, said = run("ask", "component boundaries", "--mode", "hybrid")
    assert code == 0 and "grounded in" in said.out and (tmp_path / "store" / "answers.jsonl").exists()
    code, said = run("feedback", "--query", query, "--good", chunk)
    assert code == 0, said.err
    assert run("feedback", "--query", query, "--bad", "chunk_never_shown")[0] == 2
    assert run("feedback", "--query", "nobody", "--bad", chunk)[0] == 2
    code, said = run("feedback-report")
    assert json.loads(said.out)["totalFeedback"] == 1
    assert run("feedback-report", "--report", str(report))[0] == 0
    assert [o["chunkId"] for o in json.loads(report.read_text())["observations"]] == [chunk]
    assert run("feedback-export", str(tmp_path / "fb.json"))[0] == 0 and [i["rating"] for i in json.loads((tmp_path / "fb.json").read_text())] == ["good"]
    # Whoever asks with another model than the index was made with gets no results but an error.
    class Other(Corpus):
        def __init__(self, *a):
            super().__init__(*a, model="other")

    monkeypatch.setattr(cli, "Corpus", Other)
    assert run("search", "component boundaries")[0] == 2
    assert run("eval", str(questions), "--report", str(report))[0] == 1
    said = json.loads(report.read_text())
    assert said["status"] == "failed" and "mock" in said["error"] and said["questionResults"] == []
