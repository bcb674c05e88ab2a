"""Processing only new or changed records: a work-item ledger.

An item is a record key with the value to process (a content hash, or null for
a deletion). It is *pending* while its value differs from the one last done,
*leased* by one run at a time, and *done* when that run commits. A lease whose
run failed or ran out of time returns to pending; every lease carries a fencing
token that grows with each run, so that a run that was thought dead and comes
back cannot commit; and output paths depend only on item and value, so that a
retry overwrites what an earlier attempt left.

The rules are the transitions below, expressions on one item's entry. Both forms
use them: :func:`replay` folds them over each item's events, from stored versions
and a run log, in one plan; :class:`WorkLedger` applies them to a ledger on the
shared file system, where a transition counts by one atomic commit.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomry.session import settle
from fathomry.sources.store import VersionedTable

VALUE = "struct<value:string>"
ENTRY = f"wanted {VALUE}, done {VALUE}, state string, token bigint, expires_at timestamp"


@dataclass(frozen=True)
class Entry:
    """What the ledger knows of an item: a value is a struct with a nullable ``value`` (null: deleted), a null struct means never."""

    wanted: Column
    done: Column
    state: Column
    token: Column
    expires_at: Column

    @classmethod
    def of(cls, row: Column) -> Entry:
        return cls(*[row[f.name] for f in fields(cls)])

    @classmethod
    def columns(cls) -> Entry:
        return cls(*[F.col(f.name) for f in fields(cls)])

    @classmethod
    def new(cls) -> Entry:
        kinds = dict(part.split(" ", 1) for part in ENTRY.split(", "))
        return cls(*[F.lit("pending" if name == "state" else None).cast(kind) for name, kind in kinds.items()])

    def items(self) -> list[tuple[str, Column]]:
        return [(f.name, getattr(self, f.name)) for f in fields(self)]

    def holds(self, token: Column) -> Column:
        """Whether the item is leased under this very token."""
        return F.coalesce((self.state == "leased") & (self.token == token), F.lit(False))


def expire(entry: Entry, now: Column) -> Entry:
    """A lease that ran out returns to pending."""
    return replace(entry, state=F.when((entry.state == "leased") & (entry.expires_at <= now), "pending").otherwise(entry.state))


def offer(entry: Entry, value: Column) -> Entry:
    """What is wanted now; an item whose value is done already has no work. A leased item keeps what its run took."""
    free = entry.state != "leased"
    same = value["value"].eqNullSafe(entry.done["value"])
    return replace(entry, wanted=F.when(free, value).otherwise(entry.wanted), state=F.when(free, F.when(same, "done").otherwise("pending")).otherwise(entry.state))


def lease(entry: Entry, token: Column, expires_at: Column) -> Entry:
    """A pending item goes to the run with this token, which must be newer than the item's."""
    takes = (entry.state == "pending") & (token > F.coalesce(entry.token, F.lit(0)))
    pick = lambda new, old: F.when(takes, new).otherwise(old)
    return replace(entry, state=pick("leased", entry.state), token=pick(token, entry.token), expires_at=pick(expires_at, entry.expires_at))


def commit(entry: Entry, token: Column, now: Column) -> Entry:
    """What the token's run holds is done, if its lease still lasts; any other token changes nothing."""
    lasting = entry.holds(token) & (entry.expires_at > now)
    return replace(entry, done=F.when(lasting, entry.wanted).otherwise(entry.done), state=F.when(lasting, "done").otherwise(entry.state))


def release(entry: Entry, token: Column) -> Entry:
    """What the token's run holds is pending again."""
    return replace(entry, state=F.when(entry.holds(token), "pending").otherwise(entry.state))


def run_table(runs: DataFrame) -> DataFrame:
    """The run log in order of start: ``at`` (from 0), ``run_no, run_id, started_at, status, ends_at, last`` and ``next_done``.

    ``next_done`` is the place of the first successful run from here on, null if
    there is none; ``ends_at`` is when a lease of the run ends, the start of the
    next run. Rows without a start or an id are ignored, of repeated ids the
    earliest start counts, and no status means running.
    """
    usable = runs.where(F.col("started_at").isNotNull() & F.col("run_id").isNotNull())
    once = usable.groupBy("run_id").agg(F.min(F.struct("started_at", "run_no", F.coalesce("run_status", F.lit("running")).alias("status"))).alias("row")).select("run_id", "row.*")
    order = W.orderBy("started_at", "run_no", "run_id")
    placed = once.withColumn("at", F.row_number().over(order) - 1)
    ahead = order.rowsBetween(0, W.unboundedFollowing)
    return placed.select(
        "at", "run_no", "run_id", "started_at", "status", F.lead("started_at").over(order).alias("ends_at"), F.lead("at").over(order).isNull().alias("last"),
        F.min(F.when(F.col("status") == "succeeded", F.col("at"))).over(ahead).alias("next_done"),
    )


def _first_run(arrivals: DataFrame, arrived: str, runs: DataFrame, first: datetime) -> DataFrame:
    """``arrivals`` with ``slot``, the first run that starts no earlier; rows after the last start are dropped.

    Runs are looked up by day: a row meets the starts of its own day, and the
    place of the first run after that day. ``first`` is the day of the first run.
    """
    day = lambda c: F.date_trunc("day", c)
    days = runs.agg(F.explode(F.sequence(F.lit(first), day(F.max("started_at")), F.expr("interval 1 day"))).alias("day"))
    starts = runs.groupBy(day(F.col("started_at")).alias("day")).agg(F.array_sort(F.collect_list(F.struct("started_at", "at"))).alias("starts"))
    after = F.first(F.col("starts")[0]["at"], ignorenulls=True).over(W.orderBy("day").rowsBetween(1, W.unboundedFollowing))
    calendar = days.join(starts, "day", "left").select(F.col("day").alias("__day"), "starts", after.alias("after"))
    found = arrivals.join(calendar, F.greatest(day(F.col(arrived)), F.lit(first)) == F.col("__day"))
    same_day = F.filter("starts", lambda s: s["started_at"] >= F.col(arrived))
    return found.withColumn("slot", F.coalesce(F.get(same_day, F.lit(0))["at"], F.col("after"))).where(F.col("slot").isNotNull()).drop("__day", "starts", "after")


HISTORY = "item string, run_no int, run_id string, token int, state string, value string, previous_value string, path string"
LOGGED = "array<struct<at:int,token:bigint,state:string,value:string,previous:string>>"


def _fold(events: str) -> Column:
    """All of an item's events through the transitions; the log has one entry per run that leased it."""

    def end(entry: Entry, e: Column) -> Entry:
        # A run ends before the next one starts: by its commit, by its release, or not at all.
        done, gone = commit(entry, e["token"], e["started_at"]), release(entry, e["token"])
        pick = lambda a, b, c: F.when(e["status"] == "succeeded", a).when(e["status"] == "failed", b).otherwise(c)
        return Entry(*[pick(a, b, c) for (_, a), (_, b), (_, c) in zip(done.items(), gone.items(), entry.items())])

    def step(acc: Column, e: Column) -> Column:
        parts = F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3))

        def part(inner: Column, kind: Column) -> Column:
            before = Entry.of(inner)
            stages = [expire(before, e["started_at"]), offer(before, e["value"]), lease(before, e["token"], e["ends_at"]), end(before, e)]
            after = [F.when(kind == 0, a).when(kind == 1, b).when(kind == 2, c).otherwise(d).alias(name) for (name, a), (_, b), (_, c), (_, d) in zip(*[s.items() for s in stages])]
            accepted = stages[3].state == "done"
            label = F.when(accepted, "done").when(e["last"] & (e["status"] == "running"), "leased").otherwise("expired")
            line = F.struct(e["at"].alias("at"), before.token.alias("token"), label.alias("state"), before.wanted["value"].alias("value"), before.done["value"].alias("previous"))
            log = F.when((kind == 3) & before.holds(e["token"]), F.concat(inner["log"], F.array(line))).otherwise(inner["log"])
            return F.struct(*after, log.alias("log"))

        return F.aggregate(parts, acc, part)

    zero = F.struct(*[c.alias(name) for name, c in Entry.new().items()], F.array().cast(LOGGED).alias("log"))
    return F.aggregate(events, zero, step)["log"]


def replay(versions: DataFrame, runs: DataFrame, key: str, version: str, arrived: str, value: str, deleted: Column, path: str = "items") -> DataFrame:
    """The ledger's history: one row per (item, run that leased it).

    Columns: ``item, run_no, run_id, token, state, value, previous_value, path``.
    ``state`` is ``done`` (the run succeeded and its token still held the item),
    ``expired`` (it failed, or is still marked running although a later run
    started) or ``leased`` (it is the last run and still running). ``value``
    null stands for a deletion. ``runs`` is the run log (``run_table``).

    An item's value at a run is that of its greatest ``version`` among rows that
    arrived at or before the run's start, null if that version is deleted; it is
    offered to the ledger at that start. The run's token is its place in the
    order of starts, its leases end when the next run starts, and what it did
    counts before that: a succeeded run commits, a failed one releases, one that
    never ended lets its leases expire. A run that offers what the run before
    offered, with a successful run between, cannot lease anything, so it is no
    event of the item: there are as many events as changes and retries.

    Rows without key, version or arrival are ignored; repeated rows count once;
    of several rows with the same version the greatest (deleted, value) counts.
    Without runs, or without versions, the ledger is empty.
    """
    log = settle(run_table(runs))
    facts = log.agg(F.max("at").alias("last"), F.date_trunc("day", F.min("started_at")).alias("first")).first()
    if facts.last is None:
        return versions.sparkSession.createDataFrame([], HISTORY)
    usable = versions.where(F.col(key).isNotNull() & F.col(version).isNotNull() & F.col(arrived).isNotNull()).select(
        F.col(key).cast("string").alias("item"), F.col(version).alias("v"), F.coalesce(deleted, F.lit(False)).alias("gone"), F.col(value).alias("value"), F.col(arrived).alias("arrived")
    )
    # A row shows from the first run that starts no earlier than its arrival; per item at most one row per run is left.
    per_slot = _first_run(usable, "arrived", log, facts.first).groupBy("item", "slot").agg(F.max(F.struct("v", "gone", "value")).alias("newest"))
    order = W.partitionBy("item").orderBy("slot")
    offers = per_slot.select("item", "slot", F.max("newest").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("newest")).select(
        "item", "slot", F.struct(F.when(~F.col("newest.gone"), F.col("newest.value")).alias("value")).alias("value"), F.lead("slot").over(order).alias("until")
    )
    picked = offers.join(log.select(F.col("at").alias("slot"), "next_done"), "slot")
    end = F.least(F.col("next_done"), F.col("until") - 1, F.lit(facts.last))  # least() passes over nulls
    tries = picked.select("item", "value", F.explode(F.sequence("slot", end)).alias("at")).join(log.drop("next_done"), "at")
    event = F.struct("at", (F.col("at") + 1).cast("long").alias("token"), "value", "started_at", F.coalesce("ends_at", F.lit("9999-12-31").cast("timestamp")).alias("ends_at"), "status", "last")
    folded = tries.groupBy("item").agg(F.array_sort(F.collect_list(event)).alias("events")).select("item", F.explode(_fold("events")).alias("x"))
    return folded.select("item", F.col("x.at").alias("at"), "x.token", "x.state", "x.value", F.col("x.previous").alias("previous_value")).join(log.select("at", "run_no", "run_id"), "at").select(
        "item", "run_no", "run_id", F.col("token").cast("int").alias("token"), "state", "value", "previous_value", item_path(F.lit(path), F.col("item"), F.col("value")).alias("path")
    )


def item_path(root: Column, item: Column, value: Column) -> Column:
    """Where an item's output goes: a function of item and value only."""
    return F.concat_ws("/", root, F.substring(F.sha2(item, 256), 1, 2), item, F.coalesce(F.substring(F.sha2(value, 256), 1, 16), F.lit("deleted")))


class StaleToken(RuntimeError):
    """A run tried to act with a token that is not the newest, or whose lease has expired."""


class WorkLedger:
    """A ledger in a shared folder, ``item`` and ``ENTRY``: each transition commits the entries it changes.

    The newest token is part of the commit record. A transition reads a state,
    checks its token there and works out its change; if another run commits
    first, all of that is done again on the state that run left. So of two runs
    that lease at once one gets what the other left, and a stale token is refused
    at the moment it would count.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.table = VersionedTable(spark, f"{self.root}/ledger", f"item string, {ENTRY}", "item")

    def rows(self) -> DataFrame:
        return self.table.read()

    def newest_token(self) -> int:
        return self.table.commits.newest().get("facts", {}).get("token", 0)

    @staticmethod
    def _changed(before: DataFrame, after: Entry) -> DataFrame:
        """The entries that a transition changes."""
        stays = F.lit(True)
        for name, column in after.items():
            stays &= column.eqNullSafe(F.col(name))
        return before.select("item", *[c.alias(name) for name, c in after.items()], stays.alias("__stays")).where(~F.col("__stays")).drop("__stays")

    def lease(self, wanted: DataFrame, token: int, now: datetime, expires_at: datetime, whole: bool = True) -> DataFrame:
        """Offer the wanted values (``item, value``) and lease whatever is to do to this run.

        ``wanted`` is a whole snapshot, of which absent items are deletions, or
        (``whole`` false) only what was added or changed, with a null value for
        what was deleted; items left pending by earlier runs are leased either
        way. Leases of other runs stay with them until they expire at ``now``.
        Null items are ignored, of repeated ones the greatest value counts.
        Returns the leased items with their values and output paths.
        """
        offered = wanted.where(F.col("item").isNotNull()).groupBy("item").agg(F.max("value").alias("value")).select("item", F.struct(F.col("value")).alias("offer"))
        moment = F.lit(now)

        def change(state: dict, rows: DataFrame):
            newest = state.get("facts", {}).get("token", 0)
            if token <= newest:
                raise StaleToken(f"token {token} is not newer than {newest}")
            merged = rows.withColumn("known", F.lit(True)).join(offered, "item", "full_outer").withColumn("state", F.coalesce("state", F.lit("pending")))
            absent = F.struct(F.lit(None).cast("string").alias("value")) if whole else F.col("wanted")
            entry = expire(Entry.columns(), moment)
            staged = merged.select("item", *[c.alias(n) for n, c in entry.items()], F.coalesce("offer", absent).alias("offer"), *[F.col(n).alias(f"was_{n}") for n, _ in entry.items()])
            staged = self._apply(staged, offer(Entry.columns(), F.col("offer")))
            staged = self._apply(staged, lease(Entry.columns(), F.lit(token).cast("long"), F.lit(expires_at)))
            moved = F.lit(False)
            for n, _ in entry.items():
                moved |= ~F.col(n).eqNullSafe(F.col(f"was_{n}"))
            return staged.where(moved).select("item", *[n for n, _ in entry.items()]), None, {"token": token}

        record = self.table.commit(change)
        mine = self.table._part(record["changes"][-1][1], 0).where(Entry.columns().holds(F.lit(token))) if record["changes"] else self.rows()
        value = F.col("wanted")["value"]
        return mine.select("item", value.alias("value"), item_path(F.lit(f"{self.root}/items"), F.col("item"), value).alias("path"))

    @staticmethod
    def _apply(rows: DataFrame, entry: Entry) -> DataFrame:
        return rows.withColumns(dict(entry.items()))

    def complete(self, token: int, now: datetime) -> None:
        """Mark this run's items done; refused if none are held, or the lease ran out, or a newer run took over."""

        def change(state: dict, rows: DataFrame):
            mine = Entry.columns().holds(F.lit(token))
            facts = rows.agg(F.count_if(mine).alias("n"), F.min(F.when(mine, F.col("expires_at"))).alias("until")).first()
            if not facts.n and state.get("facts", {}).get("token", 0) != token:
                raise StaleToken(f"token {token} holds no lease")
            if facts.n and facts.until <= now:
                raise StaleToken(f"the lease of token {token} expired at {facts.until}")
            return self._changed(rows, commit(Entry.columns(), F.lit(token), F.lit(now))), None, {}

        self.table.commit(change)

    def release(self, token: int) -> None:
        """Give this run's items back (it failed and says so)."""
        self.table.commit(lambda state, rows: (self._changed(rows, release(Entry.columns(), F.lit(token))), None, {}))
