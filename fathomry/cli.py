"""Command line: ingest, search, eval, ask, feedback, its export and report, and a self-check, over one store folder.

Exit codes: 0 fine, 1 an evaluation failed or missed its threshold, 2 bad input, 3 the language model failed.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fathomry.operators import answer, evaluate, feedback
from fathomry.operators.ingest import Corpus
from fathomry.operators.search import MODES, run_records, search
from fathomry.operators.vector import vector_candidates
from fathomry.session import settle
from fathomry.sources import jsonl
from fathomry.sources.files import parse_files, scan_folder
from fathomry.sources.store import VersionedTable

CONTEXT_WORDS = 3000
RESULT = "struct<rank:int,chunk_id:string,document_id:string,source_path:string,score:double,preview:string,heading_path:array<string>>"
EVIDENCE = (
    f"retrieval_run_id string, query_id string, question_text string, search_mode string, top_k int, filters string, results array<{RESULT}>, latency_ms double, "
    "below_threshold_count long, reason string, created_at string"
)
FOUND = (
    "query_id string, rank int, chunk_id string, document_id string, source_path string, score double, preview string, heading_path array<string>, vector_score double, keyword_score double"
)
FEEDBACK = (
    "id string, query_id string, retrieval_run_id string, chunk_id string, document_id string, rating string, note string, search_mode string, rank int, score double, "
    "source_path string, question_text string, created_at string"
)


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


def new_id(prefix: str, number: int = 0) -> str:
    return f"{prefix}_{int(time.time() * 1000)}_{os.getpid()}_{number}"


class Store:
    """What the commands share: the corpus, the evidence log and the feedback table below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.corpus = Corpus(spark, root)
        self.feedback = VersionedTable(spark, f"{root}/feedback", FEEDBACK, "id")

    def evidence(self) -> DataFrame:
        return jsonl.read_log(self.spark, f"{self.root}/evidence", EVIDENCE, check=True)

    def search(self, questions: DataFrame, mode: str, top_k: int, explain: bool = False) -> DataFrame:
        asked = questions.withColumn("vector", self.corpus.embed(F.col("text")))
        return search(asked, self.corpus.chunks.read(), self.corpus.documents.read(), mode, top_k, self.corpus.vectors.read(), explain=explain, model=(self.corpus.model, self.corpus.dimension))

    def records(self, questions: DataFrame, found: DataFrame, mode: str, top_k: int, latency_ms: float) -> DataFrame:
        return run_records(questions, found, self.corpus.documents.read(), mode, top_k, latency_ms, now())


def one_question(spark: SparkSession, args: argparse.Namespace, query: str) -> DataFrame:
    return spark.createDataFrame([(query, args.text, args.project, args.tag or None, args.source)], "query_id string, text string, project string, tags array<string>, source string")


def run_search(store: Store, args: argparse.Namespace) -> tuple[Row, DataFrame, list]:
    """The run's record, which is logged, and the results with their explanations."""
    query, began = new_id("qry"), time.time()
    asked = one_question(store.spark, args, query).withColumn("retrieval_run_id", F.lit(new_id("rrun")))
    rows = store.search(asked, args.mode, args.top_k, getattr(args, "explain", False)).orderBy("rank").collect()
    latency = 1000 * (time.time() - began)
    found = store.spark.createDataFrame(rows, FOUND + (", reason string" if getattr(args, "explain", False) else ""))
    record = store.records(asked, found, args.mode, args.top_k, latency)
    logged = record.withColumnRenamed("completed_at", "created_at")
    jsonl.append_log(logged, f"{store.root}/evidence")
    return record.first(), found, rows


def cmd_ingest(store: Store, args: argparse.Namespace) -> int:
    parsed = parse_files(scan_folder(store.spark, args.folder))
    print(json.dumps(store.corpus.ingest(parsed, now(), args.folder, args.project, tuple(args.tag or ()), args.force, args.dry_run).first().asDict()))
    return 0


def cmd_search(store: Store, args: argparse.Namespace) -> int:
    record, _, rows = run_search(store, args)
    print(f"query {record.query_id}  run {record.retrieval_run_id}  mode {args.mode}  filters {record.filters}  {len(rows)} results in {record.latency_ms:.0f} ms")
    if record.reason == "indexEmpty":
        print("the index is empty")
    if record.below_threshold_count:
        print(f"{record.below_threshold_count} results are below the similarity threshold")
    for r in rows:
        print(f"{r.rank}. {r.score:.4f}  {r.source_path}  {' > '.join(r.heading_path or [])}  {r.chunk_id}\n   {r.preview}")
        if args.explain:
            print(f"   {r.reason}")
    return 0


def cmd_eval(store: Store, args: argparse.Namespace) -> int:
    run = {
        "run_id": new_id("evr"), "generated_at": now(), "dataset_path": args.questions, "search_mode": args.mode, "top_k": args.top_k,
        "embedding_model": {"name": store.corpus.model, "dimension": store.corpus.dimension},
    }
    questions = jsonl.load_questions(store.spark, args.questions)
    depth, began = max(args.top_k, evaluate.LEAST_DEPTH), time.time()
    asked = questions.withColumnRenamed("question_id", "query_id")
    try:
        found = settle(store.search(asked, args.mode, depth))
    except ValueError as error:
        # A search that cannot run is a failed run, not one of no hits.
        if args.report:
            jsonl.write_record(run | {"status": "failed", "error": str(error), "metrics": {}, "question_results": []}, args.report)
        print(json.dumps({"run_id": run["run_id"], "status": "failed", "error": str(error)}))
        return 1
    latency = 1000 * (time.time() - began) / max(1, questions.count())
    judged = settle(evaluate.judge(questions, found, store.records(asked, found, args.mode, depth, latency)))
    row = evaluate.gate(evaluate.metrics(judged, args.mode), args.fail_below_hit_at_3).first()
    measured = {k: v for k, v in row.asDict().items() if k != "status"}
    if args.report:
        jsonl.write_record(run | {"status": row.status, "metrics": measured}, args.report, question_results=judged.join(questions.select("question_id", F.col("text").alias("question_text")), "question_id").orderBy("question_id"))
    print(json.dumps({"run_id": run["run_id"], **row.asDict()}))
    return int(row.status != "completed")


def cmd_ask(store: Store, args: argparse.Namespace) -> int:
    run, found, _ = run_search(store, args)
    question = one_question(store.spark, args, run.query_id)
    prompted = answer.prompts(question, answer.context(found, args.mode, CONTEXT_WORDS))
    row = answer.answers(question, found, answer.offline_replies(prompted)).first()
    record = {"id": new_id("ans"), "retrieval_run_id": run.retrieval_run_id, **row.asDict(recursive=True), "created_at": now()}
    os.makedirs(store.root, exist_ok=True)
    with open(f"{store.root}/answers.jsonl", "a", encoding="utf-8") as log:
        log.write(json.dumps(record) + "\n")
    print(row.answer_text or f"no answer: {row.no_answer_reason}")
    for c in row.citations:
        print(f"  [{c.rank}] {c.source_path}  {c.chunk_id}")
    return 3 if row.no_answer_reason == "llmProviderError" else 0


def cmd_feedback(store: Store, args: argparse.Namespace) -> int:
    evidence = feedback.latest_runs(store.evidence(), "retrieval_run_id")
    run = args.run
    if run is None:
        latest = feedback.latest_runs(store.evidence().where(F.col("query_id") == args.query), "query_id").first()
        if latest is None:
            raise ValueError(f"no run of query {args.query}")
        run = latest.retrieval_run_id
    rated = [(c, "good") for c in args.good or []] + [(c, "bad") for c in args.bad or []]
    if not rated:
        raise ValueError("nothing is rated")
    rows = [(new_id("fb", i), args.query, run, c, rating, args.note, now()) for i, (c, rating) in enumerate(rated)]
    inputs = store.spark.createDataFrame(rows, "id string, query_id string, retrieval_run_id string, chunk_id string, rating string, note string, created_at string")
    store.feedback.insert_new(feedback.record_feedback(inputs, evidence, store.feedback.read()))
    print(f"{len(rows)} recorded for {run}")
    return 0


def cmd_report(store: Store, args: argparse.Namespace) -> int:
    items = store.feedback.read()
    parts = {
        "problematicQueries": feedback.problem_queries(items), "frequentlyDownvotedChunks": feedback.downvoted_chunks(items),
        "queriesWithNoGoodResult": feedback.queries_without_good(items), "candidatesForRechunking": feedback.rechunk_candidates(items),
    }
    report = {"id": new_id("fbrep"), "generatedAt": now(), "totalFeedback": items.count(), **{k: [r.asDict() for r in v.limit(args.most).collect()] for k, v in parts.items()}}
    if args.report:
        # The file lists every item, the screen none.
        jsonl.write_record(report, args.report, observations=feedback.observations(items))
    print(json.dumps(report, indent=2))
    return 0


def cmd_export(store: Store, args: argparse.Namespace) -> int:
    jsonl.export_feedback(feedback.select_feedback(store.feedback.read(), args.since, args.until, args.rating), args.path)
    return 0


def cmd_spike(store: Store, args: argparse.Namespace) -> int:
    """The smallest self-check: distances ascend and the nearest of three pairs come first."""
    rows = [("a1", [1.0, 0.0]), ("a2", [0.9, 0.1]), ("b1", [0.0, 1.0])]
    spark = store.spark
    found = vector_candidates(
        spark.createDataFrame([("q", [0.95, 0.05])], "query_id string, vector array<double>"), spark.createDataFrame(rows, "id string, vector array<double>"), "id", "vector", 3
    ).orderBy("vector_rank").collect()
    fine = {found[0].record, found[1].record} == {"a1", "a2"} and all(a.distance <= b.distance for a, b in zip(found, found[1:]))
    print("ok" if fine else "failed")
    return int(not fine)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fathomry", description=__doc__)
    top.add_argument("--store", default="store", help="folder of the corpus, its logs and feedback")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *positional: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(action=run)
        for argument in positional:
            p.add_argument(argument)
        return p

    p = add("ingest", cmd_ingest, "folder")
    p.add_argument("--project")
    p.add_argument("--tag", action="append")
    p.add_argument("--force", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    for name, run in (("search", cmd_search), ("ask", cmd_ask)):
        p = add(name, run, "text")
        p.add_argument("--mode", default="vector")
        p.add_argument("--top-k", type=int, default=8)
        p.add_argument("--project")
        p.add_argument("--tag", action="append")
        p.add_argument("--source")
        if name == "search":
            p.add_argument("--explain", action="store_true")
    p = add("eval", cmd_eval, "questions")
    p.add_argument("--mode", default="vector")
    p.add_argument("--top-k", type=int, default=8)
    p.add_argument("--fail-below-hit-at-3", type=float)
    p.add_argument("--report")
    p = add("feedback", cmd_feedback)
    p.add_argument("--query", required=True)
    p.add_argument("--run")
    p.add_argument("--good", action="append")
    p.add_argument("--bad", action="append")
    p.add_argument("--note")
    p = add("feedback-report", cmd_report)
    p.add_argument("--most", type=int, default=50, help="rows of each section")
    p.add_argument("--report", help="file for the report with all observations")
    p = add("feedback-export", cmd_export, "path")
    p.add_argument("--since")
    p.add_argument("--until")
    p.add_argument("--rating", choices=feedback.RATINGS)
    add("spike", cmd_spike)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    if getattr(args, "mode", "vector") not in MODES:
        print(f"unknown search mode {args.mode!r}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("fathomry").getOrCreate()
    try:
        return args.action(Store(spark, args.store), args)
    except ValueError as error:
        print(error, file=sys.stderr)
        return 1 if args.command == "eval" else 2


if __name__ == "__main__":
    sys.exit(main())
