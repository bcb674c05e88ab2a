"""JSON sources and sinks: evidence logs, answer logs, evaluation sets and reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVIDENCE = (
    "retrievalRunId string, queryId string, questionText string, searchMode string, topK int, createdAt string, "
    "results array<struct<rank:int,chunkId:string,documentId:string,sourcePath:string,score:double,preview:string,headingPath:array<string>>>"
)
QUESTIONS = "id string, question string, expectedChunkIds array<string>, expectedSourceFiles array<string>"


def _missing(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return not found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def malformed_lines(spark: SparkSession, path: str, schema: str = EVIDENCE) -> DataFrame:
    """``file, line, text`` of every line that is not an object of the schema; lines count from 1 in their file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    # A file's lines lie in order on one task or on several in a row: a line's number is its place there after those of the tasks before.
    shares = lines.groupBy("file", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    read = F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    bad = lines.where((F.trim("value") != "") & (read["__bad"].isNotNull() | read.isNull()))
    return bad.join(shares.withColumn("before", before), ["file", "part"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))


def read_log(spark: SparkSession, path: str, schema: str = EVIDENCE, check: bool = False) -> DataFrame:
    """A JSON-lines log; blank lines are skipped, and a missing file is an empty log.

    A malformed line fails the job that reads it; with ``check`` the log is read
    through at once, and the error names the first such line.
    """
    if _missing(spark, path):
        return spark.createDataFrame([], schema)
    if check:
        bad = malformed_lines(spark, path, schema).orderBy("file", "line").first()
        if bad is not None:
            raise ValueError(f"invalid log line {bad.line} of {bad.file}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; nulls are written as such."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set (a JSON array); raises if it is empty or a question has no ground truth."""
    rows = spark.read.schema(QUESTIONS).option("multiLine", "true").option("mode", "FAILFAST").json(path).select(
        F.col("id").alias("question_id"), F.col("question").alias("text"),
        F.coalesce("expectedChunkIds", F.array().cast("array<string>")).alias("expected_chunk_ids"),
        F.coalesce("expectedSourceFiles", F.array().cast("array<string>")).alias("expected_source_files"),
    )
    bare = F.count_if((F.size("expected_chunk_ids") == 0) & (F.size("expected_source_files") == 0))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), bare.alias("bare")).first()
    if not facts.n:
        raise ValueError(f"{path} has no questions")
    if facts.bare:
        raise ValueError(f"{facts.bare} questions without ground truth")
    return rows


def _camel(value):
    """Names of nested records in camel case."""
    if isinstance(value, dict):
        return {k.split("_")[0] + "".join(p.title() for p in k.split("_")[1:]): _camel(v) for k, v in value.items()}
    return [_camel(v) for v in value] if isinstance(value, (list, tuple)) else value


def write_report(row: DataFrame, path: str) -> None:
    """A one-row result as pretty JSON with camel-case names."""
    found = row.limit(2).collect()
    if len(found) != 1:
        raise ValueError("a report is one row")
    write_record(found[0].asDict(recursive=True), path)


def write_record(record: dict, path: str, **lists: DataFrame) -> None:
    """A record as one JSON object with camel-case names, and after it the rows of ``lists``, written as they come."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(_camel(record), indent=2, default=str).removesuffix("\n}"))
        for name, rows in lists.items():
            f.write(f",\n  {json.dumps(next(iter(_camel({name: 0}))))}: ")
            _write_rows(rows, f)
        f.write("\n}\n")


def _write_rows(rows: DataFrame, f) -> None:
    """Rows as a JSON array; the driver holds one partition of them at a time."""
    mark = "["
    for row in rows.toLocalIterator():
        f.write(f"{mark}\n    " + json.dumps(_camel(row.asDict(recursive=True)), default=str))
        mark = ","
    f.write("[]" if mark == "[" else "\n  ]")


def export_feedback(items: DataFrame, path: str) -> None:
    """All items in order of time and id, as one JSON array."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        _write_rows(items.orderBy("created_at", "id"), f)
        f.write("\n")
