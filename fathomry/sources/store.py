"""Tables kept as commits below a folder: what changed is written, then made known by one atomic record."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.session import settle

# After so many changes on top of each other a table is written whole once more.
COMPACT_AT = 16


class Commits:
    """Numbered JSON records below ``root``, each created whole or not at all, and only if its number is free.

    On a local or mounted POSIX file system a record appears by a hard link, on
    others by a rename that refuses a name in use (HDFS). Of two writers of the
    same number one wins, and the other is told.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = self._paths(self.root).toUri().getPath() if self._files.getScheme() == "file" else None
        self._read = lambda path: spark._jvm.org.apache.commons.io.IOUtils.toString(self._files.open(path), "UTF-8")

    def newest(self) -> dict:
        """The last record; ``{"version": 0}`` where there is none."""
        folder = self._paths(self.root)
        if not self._files.exists(folder):
            return {"version": 0}
        names = [s.getPath() for s in self._files.listStatus(folder)]
        numbered = [(int(p.getName()[1:-5]), p) for p in names if p.getName().startswith("v") and p.getName().endswith(".json")]
        return json.loads(self._read(max(numbered, key=lambda x: x[0])[1])) if numbered else {"version": 0}

    def create(self, record: dict) -> bool:
        """Whether the record's number was still free and is now this record's."""
        name, draft = f"v{record['version']:012d}.json", f"draft-{uuid.uuid4().hex}"
        if self._local is not None:
            os.makedirs(self._local, exist_ok=True)
            kept = os.path.join(self._local, draft)
            with open(kept, "w", encoding="utf-8") as f:
                json.dump(record, f)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(kept, os.path.join(self._local, name))
            except FileExistsError:
                return False
            finally:
                os.unlink(kept)
            return True
        kept, target = self._paths(f"{self.root}/{draft}"), self._paths(f"{self.root}/{name}")
        out = self._files.create(kept, False)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        won = not self._files.exists(target) and self._files.rename(kept, target)
        if not won:
            self._files.delete(kept, False)
        return won


Change = Callable[[dict, DataFrame], tuple[DataFrame, DataFrame | None, dict]]


class VersionedTable:
    """A table below ``root`` whose rows belong to keys; a change replaces all rows of the keys it touches.

    Each commit writes only the rows of touched keys, and the keys that are gone;
    a reader takes of every key the rows of its newest commit. Every so many
    commits the table is written whole once more. A change that another writer
    forestalls is worked out again on what that one left, so none is lost. A
    missing table is an empty one, and a commit counts once its record is there,
    so a writer that dies leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        self.columns = spark.createDataFrame([], schema).columns
        self.commits = Commits(spark, f"{self.root}/commits")

    def read(self) -> DataFrame:
        return self._rows(self.commits.newest())

    def _part(self, name: str, version: int) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, __gone boolean").parquet(f"{self.root}/data/{name}").withColumn("__version", F.lit(version))

    def _rows(self, state: dict) -> DataFrame:
        base = [self._part(state["base"], 0)] if state.get("base") else []
        changes = [self._part(name, version) for version, name in state.get("changes", [])]
        if not base and not changes:
            return self.spark.createDataFrame([], self.schema)
        whole = (base + changes)[0]
        for part in (base + changes)[1:]:
            whole = whole.unionByName(part)
        if changes:
            touched = changes[0]
            for part in changes[1:]:
                touched = touched.unionByName(part)
            newest = touched.groupBy(F.col(self.key).alias("__key")).agg(F.max("__version").alias("__newest"))
            whole = whole.join(newest, F.col(self.key).eqNullSafe(F.col("__key")), "left").where(F.col("__version") >= F.coalesce("__newest", F.lit(0)))
        return whole.where(~F.col("__gone")).select(*self.columns)

    def _write(self, rows: DataFrame, gone: DataFrame | None) -> str:
        name = uuid.uuid4().hex
        kept = self.spark.createDataFrame([], self.schema).unionByName(rows, allowMissingColumns=True).select(*self.columns).withColumn("__gone", F.lit(False))
        if gone is not None:
            # A key that has rows among the new ones is replaced, not gone.
            absent = gone.select(self.key).distinct().join(rows.select(self.key).distinct(), self.key, "left_anti")
            kept = kept.unionByName(absent.withColumn("__gone", F.lit(True)), allowMissingColumns=True)
        kept.write.parquet(f"{self.root}/data/{name}")
        return name

    def commit(self, change: Change) -> dict:
        """Apply ``change(record, rows) -> (new rows, gone keys, facts)`` to the newest state; returns the new record.

        ``facts`` are kept in the record. If another writer commits first, the
        change is worked out again on the new state, so what it checks there
        holds at the moment it counts.
        """
        while True:
            state = self.commits.newest()
            rows, gone, facts = change(state, self._rows(state))
            version = state["version"] + 1
            changes = [*state.get("changes", []), [version, self._write(rows, gone)]]
            record = {"version": version, "base": state.get("base"), "changes": changes, "facts": {**state.get("facts", {}), **facts}}
            if self.commits.create(record):
                if len(changes) >= COMPACT_AT:
                    self.compact()
                return record

    def compact(self) -> bool:
        """Write the table whole; given up (False) if another writer commits meanwhile."""
        state = self.commits.newest()
        return self.commits.create({**state, "version": state["version"] + 1, "base": self._write(self._rows(state), None), "changes": []})

    def replace(self, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Replace all rows of the keys that ``rows`` has (a document's chunks), and drop the keys in ``gone``."""
        self.commit(lambda state, now: (rows, gone, {}))

    def upsert(self, rows: DataFrame) -> None:
        """Replace or add one row by key; of repeated keys among the new rows any one counts."""
        self.replace(rows.dropDuplicates([self.key]))

    def insert_new(self, rows: DataFrame) -> None:
        """Append rows whose keys are new; a key that repeats or exists refuses the whole batch."""
        rows = settle(rows)

        def change(state: dict, now: DataFrame):
            twice = rows.groupBy(self.key).count().where("count > 1").select(self.key)
            known = rows.join(now.select(self.key), self.key, "left_semi").select(self.key)
            bad = [r[0] for r in twice.unionByName(known).limit(5).collect()]
            if bad:
                raise ValueError(f"keys repeat or exist already: {bad}")
            return rows, None, {}

        self.commit(change)

    def delete(self, keys: DataFrame) -> None:
        self.replace(self.spark.createDataFrame([], self.schema), keys)


def check_dimension(vectors: DataFrame, vector: str, dimension: int) -> DataFrame:
    """Rows as they are; reading one whose vector has another length fails the job."""
    fits = F.coalesce(F.size(vector) == dimension, F.lit(False))
    return vectors.where(F.assert_true(fits, F.lit(f"vector of another length than {dimension}")).isNull())
