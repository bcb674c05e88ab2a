"""Mixing sources to target weights, by cube-method balanced sampling.

A source that should give W tokens and has A is used W / A times on average:
every document floor(W / A) times, and the rest drawn with the fractional
probability that is left. The draw moves each block's vector of probabilities
through the null space of its constraints (tokens and documents), so that both
totals stay as they are, until at most as many documents as constraints are
undecided per block; those of all blocks are pooled and moved again, round by
round, and the few that are left in the end are landed.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomry.session import settle, spread

CONSTRAINTS = 2
EPSILON = 1e-9
# Documents whose probabilities one block moves, and blocks moved side by side by one task.
BLOCK = 1000
SIDE = 64
# A plan of at most so many sources, a few bytes each, is sent to every task; a larger one is joined over shuffles.
BROADCAST_SOURCES = 100_000


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE of a ``.tiktoken`` file, made once per process."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def with_tokens(df: DataFrame, record: str, text: str, source: str, tokenizer: str | None = None) -> DataFrame:
    """``record, source, tokens`` of every row; null and empty texts have 0 tokens."""
    path = tokenizer or default_tokenizer()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"record": batch["record"], "source": batch["source"], "tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    picked = df.select(F.col(record).cast("long").alias("record"), F.col(source).alias("source"), F.col(text).alias("text"))
    return spread(picked).mapInPandas(each, "record long, source string, tokens long")


PLAN = "source string, target_share double, max_repeats int, documents long, tokens long, wanted_tokens double, ratio double"


def plan_shares(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source in the targets has and should give (``PLAN``); the whole is all tokens, of any source or none.

    ``ratio`` is how often a document is to be used on average. Of repeated
    targets of a source the largest share counts, with its repeats; null sources
    are ignored, null shares and repeats below 1 count as nothing to give.
    """
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    asked = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))).alias("goal")
    )
    wanted = F.col("goal.target_share") * F.lit(float(total))
    joined = asked.join(have, "source", "left").withColumns({"documents": F.coalesce("documents", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0)), "wanted_tokens": wanted})
    ratio = F.when(F.col("tokens") > 0, F.least(F.col("wanted_tokens") / F.col("tokens"), F.col("goal.max_repeats").cast("double"))).otherwise(F.lit(0.0))
    return settle(joined.select("source", "goal.target_share", "goal.max_repeats", "documents", "tokens", "wanted_tokens", ratio.alias("ratio")))


def _directions(x: np.ndarray) -> np.ndarray:
    """Per block a vector in the null space of its ``q`` constraints over ``q + 1`` units: ``x`` is (blocks, units, q), q 1 or 2."""
    u = np.zeros(x.shape[:2])
    if x.shape[2] == 1:
        u[:, 0], u[:, 1] = x[:, 1, 0], -x[:, 0, 0]
    else:
        u = np.cross(x[:, :, 0], x[:, :, 1])
    # Where the constraints depend on each other, of equal units one may take what another gives.
    flat = np.abs(u).max(axis=1) < 1e-12
    u[flat] = 0.0
    u[flat, 0], u[flat, 1] = 1.0, -1.0
    if x.shape[2] == 1:
        u[flat & (np.abs(x[:, :, 0]).max(axis=1) < 1e-12)] = (1.0, 0.0)
    return u


def flights(pi: list[np.ndarray], x: list[np.ndarray], rng: np.random.Generator) -> list[np.ndarray]:
    """Move each block's probabilities through the null space of its ``x.T`` until at most ``q`` of it are fractional.

    ``x`` holds what each unit adds to the ``q`` constraints (1 or 2) if drawn:
    each block's ``sum(x * pi)`` keeps its value. Units are taken q + 1 at a time, as
    only that many are needed for a direction to exist; all blocks take their steps side by side.
    """
    blocks, q = len(pi), x[0].shape[1] if x else 0
    longest = max((len(p) for p in pi), default=0)
    if not longest or not q:
        return [p.copy() for p in pi]
    probability, add = np.zeros((blocks, longest)), np.zeros((blocks, longest, q))
    todo, n_todo = np.zeros((blocks, longest), np.int64), np.zeros(blocks, np.int64)
    for b, (p, a) in enumerate(zip(pi, x)):
        scale = np.abs(a).max(axis=0, initial=0.0)
        probability[b, : len(p)], add[b, : len(p)] = p, a / np.where(scale > 0, scale, 1.0)
        waiting = np.flatnonzero((p > EPSILON) & (p < 1 - EPSILON))
        todo[b, : len(waiting)], n_todo[b] = waiting, len(waiting)
    active, next_up, rows = np.full((blocks, q + 1), -1, np.int64), np.zeros(blocks, np.int64), np.arange(blocks)
    while True:
        for k in range(q + 1):
            fill = np.flatnonzero((active[:, k] < 0) & (next_up < n_todo))
            active[fill, k] = todo[fill, next_up[fill]]
            next_up[fill] += 1
        going = rows[(active >= 0).all(axis=1)]
        if not len(going):
            break
        at = active[going]
        p, u = probability[going[:, None], at], _directions(add[going[:, None], at])
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 1e-15, (1 - p) / u, np.where(u < -1e-15, -p / u, np.inf)).min(axis=1)
            down = np.where(u > 1e-15, p / u, np.where(u < -1e-15, (p - 1) / u, np.inf)).min(axis=1)
        step = np.where(rng.random(len(going)) * (up + down) < down, up, -down)
        p = p + step[:, None] * u
        p[p < EPSILON], p[p > 1 - EPSILON] = 0.0, 1.0
        probability[going[:, None], at] = p
        active[going] = np.where((p > 0) & (p < 1), at, -1)
    return [probability[b, : len(p)] for b, p in enumerate(pi)]


def flight(pi: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One block's flight."""
    return flights([pi], [x], rng)[0]


def land(pi: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide the units a flight leaves: drop constraints from the last one on, then draw."""
    for q in range(x.shape[1], 0, -1):
        pi = flight(pi, x[:, :q], rng)
    left = (pi > 0) & (pi < 1)
    pi[left] = (rng.random(left.sum()) < pi[left]).astype(float)
    return pi


def _fly(seed: int, round_no: int, last: bool, block: int):
    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("record", ignore_index=True)
        rng = np.random.default_rng([seed, round_no, int(key[1]), *key[0].encode()])
        pi = rows["pi"].to_numpy(float)
        # Tokens first: they are the last constraint that landing drops.
        x = np.column_stack([rows["tokens"].to_numpy(float), np.ones(len(rows))])
        if last:
            moved = land(pi, x, rng)
        else:
            order = rng.permutation(len(rows))
            parts = np.array_split(order, max(1, len(rows) // block))
            moved = np.empty(len(rows))
            for part, values in zip(parts, flights([pi[p] for p in parts], [x[p] for p in parts], rng)):
                moved[part] = values
        rows["pi"] = moved
        return rows[["record", "source", "tokens", "base", "pi"]]

    return each


MIXED = "record long, source string, tokens long, base int, pi double"


def mix(sized: DataFrame, shares: DataFrame, seed: int = 17, block: int = BLOCK, side: int = SIDE) -> DataFrame:
    """``record, source, tokens, repeats`` of every document used at least once.

    ``sized`` has one row per document; repeated ids are documents of their own.
    Sources beyond their reach are used ``max_repeats`` times whole. Documents
    of null or unlisted sources, and of sources that have no tokens, are not
    used. A hot source is spread over as many groups of ``side`` blocks as its
    documents need, groups lie on as many tasks whatever their bytes, and
    undecided documents are pooled by rounds.
    """
    spark = sized.sparkSession
    whole = F.floor(F.col("ratio") + F.lit(EPSILON)).cast("int")
    plan = shares.where((F.col("tokens") > 0) & (F.col("max_repeats") > 0) & (F.col("wanted_tokens") > 0)).select(
        "source", whole.alias("base"), F.greatest(F.lit(0.0), F.col("ratio") - whole).alias("pi"), F.greatest(F.lit(1), F.ceil(F.col("documents") / (block * side)).cast("int")).alias("groups")
    )
    facts = plan.agg(F.count(F.lit(1)).alias("n"), F.max("groups").alias("most"), F.sum("groups").alias("all")).first()
    if not facts.n:
        return spark.createDataFrame([], "record long, source string, tokens long, repeats int")
    start = sized.join(F.broadcast(plan) if facts.n <= BROADCAST_SOURCES else plan, "source")
    at = lambda round_no, groups: F.pmod(F.xxhash64("record", F.lit(seed + round_no)), groups).cast("int")
    parts = [start.where(F.col("pi") <= EPSILON).select("record", "source", "tokens", "base", F.lit(0.0).alias("pi"))]
    current = start.where(F.col("pi") > EPSILON).withColumn("part", at(0, F.col("groups")))
    most, every, round_no = facts.most, facts.all, 0
    while True:
        # A pool that one block can hold is landed.
        last = round_no > 0 and most == 1
        tasks = max(1, min(every, 20 * spark.sparkContext.defaultParallelism + every // 16))
        moved = settle(current.repartition(tasks, "source", "part").groupBy("source", "part").applyInPandas(_fly(seed, round_no, last, block), MIXED))
        if last:
            parts.append(moved)
            break
        undecided = (F.col("pi") > 0) & (F.col("pi") < 1)
        parts.append(moved.where(~undecided))
        # At most CONSTRAINTS documents of each block are left, of a group so many times its blocks.
        round_no, most = round_no + 1, math.ceil(most * side * CONSTRAINTS / (block * side))
        every = facts.n * most
        current = moved.where(undecided).withColumn("part", at(round_no, F.lit(most)))
    return reduce(DataFrame.unionByName, parts).select("record", "source", "tokens", (F.col("base") + F.round("pi").cast("int")).alias("repeats")).where(F.col("repeats") > 0)


def mix_report(mixed: DataFrame, shares: DataFrame) -> DataFrame:
    """Per source of the plan: what it should give, what it gives, how often its documents are used, and whether the mix leaves it ``short``.

    ``actual_share`` is the source's part of the tokens mixed. A source is short
    if the mix gives fewer tokens than wanted although it uses every token of
    the source as often as allowed.
    """
    used = settle(mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.sum("repeats").alias("mixed_documents"), F.max("repeats").alias("most_repeats")
    ))
    whole = used.agg(F.sum("mixed_tokens")).first()[0] or 0
    given = F.coalesce("mixed_tokens", F.lit(0))
    exhausted = given >= F.col("tokens") * F.col("max_repeats")
    return shares.join(used, "source", "left").select(
        *[c for c in shares.columns if c != "ratio"],
        given.alias("mixed_tokens"),
        F.coalesce("mixed_documents", F.lit(0)).alias("mixed_documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        (given / F.lit(float(whole) or 1.0)).alias("actual_share"),
        (exhausted & (given < F.col("wanted_tokens"))).alias("short"),
    )
