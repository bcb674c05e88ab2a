"""Most similar vectors for every vector, by a permutation index with pivot inverted files.

A vector is represented by its pivots in order of nearness, and posted in the
inverted file of the first of them. A query ranks the files by footrule distance:
between its own permutation and the entries' prefix of one pivot, that is the
place of the file's pivot in the query's order, the same for all of a file's
entries. The entries of its ``probes`` nearest files are reranked by cosine, all
of them. Files of pivots that lie close together share a shelf.

Every vector is written once, to its shelf in the folder that all executors
share. A task takes a block of queries and reads the shelves they look into one
after the other, so that what is on disk grows with the vectors alone and not
with the shelves a query looks into.

The pivots are a bounded random sample of the vectors; every vector is posted
and every vector is a query. Their number grows with the square root of the
number of vectors, so that files grow as slowly as the number of files does.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomry.session import shared_dir

# The pivots are sent to every task: at most so many, whatever the collection's size.
MAX_PIVOTS = 8192
# A shelf holds about so many entries, and fewer where that would leave cores idle, but about SMALL at least.
BLOCK, SMALL = 65_536, 4096
# Queries of one task, at most about so many.
QUERIES = 65_536
# A query looks into files of about so many entries at least.
LEAST = 4096
# Cells of one block of cosines; entries read at once.
CELLS, READ = 2_000_000, 16_384
# The sample that bounds a query's k-th best cosine from below: so many vectors, or one in so many where there are fewer.
SAMPLE, ONE_IN = 2048, 16


@dataclass(frozen=True)
class Index:
    """``pivots``: unit vectors, one a row, those of one shelf next to each other; ``probes``: files each query looks into.

    ``starts``: each shelf's first pivot. ``sample``: more of the collection's
    vectors. A query's k-th best cosine is no less than that among them, which
    rules most entries out beforehand.
    """

    pivots: np.ndarray
    probes: int
    starts: np.ndarray
    sample: np.ndarray

    def shelf(self, file: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, file, "right").astype(np.int32) - 1


@dataclass(frozen=True)
class Code:
    """Vectors as bytes that sort as the vectors do, ``width`` bytes a value; two where no value needs more."""

    dimension: int
    width: int

    def pack(self, lists: pa.Array) -> pa.Array:
        """Lists of any length; null lists stay null. An absent value is zero bytes, the least of all."""
        flat = lists.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float32) + np.float32(0)  # -0.0 and 0.0 are the same value
        values[np.isnan(values)] = np.nan
        with np.errstate(over="ignore"):
            bits = values.astype(f"f{self.width}").view(f"u{self.width}")
        sign = bits.dtype.type(1 << (8 * self.width - 1))
        codes = np.where(bits & sign, ~bits, bits | sign)
        codes[np.asarray(flat.is_null())] = 0
        ends = np.cumsum(np.append(0, np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))) * self.width
        packed = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(codes.astype(f">u{self.width}"))])
        return pc.if_else(lists.is_valid(), packed, pa.scalar(None, pa.binary()))

    def unpack(self, packed: pa.Array) -> np.ndarray:
        """Rows of values from whole vectors."""
        _, ends, values = packed.buffers()
        if not len(packed):
            return np.empty((0, self.dimension), np.float32)
        ends = np.frombuffer(ends, np.int32)
        codes = np.frombuffer(values, np.uint8)[ends[packed.offset] : ends[packed.offset + len(packed)]].view(f">u{self.width}").astype(f"u{self.width}").reshape(-1, self.dimension)
        sign = codes.dtype.type(1 << (8 * self.width - 1))
        return np.where(codes & sign, codes ^ sign, ~codes).view(f"f{self.width}").astype(np.float32)

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Of each batch the rows whose vectors count, and these."""
        for batch in batches:
            whole = batch.filter(pc.equal(pc.binary_length(batch.column("packed")), self.dimension * self.width))
            rows = self.unpack(whole.column("packed"))
            good = np.isfinite(rows).all(axis=1) & rows.any(axis=1)
            yield whole.filter(pa.array(good)), rows[good]


def default_pivots(n: int) -> int:
    return max(8, min(MAX_PIVOTS, round(2.4 * math.sqrt(n))))


def default_probes(pivots: int, n: int) -> int:
    """Files to look into: enough for about ``LEAST`` entries, so that a small collection is searched whole."""
    return max(1, min(pivots, max(round(2.4 * math.sqrt(pivots)), math.ceil(pivots * LEAST / max(1, n)))))


def shelve(pivots: np.ndarray, most: int) -> list[np.ndarray]:
    """Pivots in groups of at most ``most`` that lie close together: halved along the widest direction until small enough."""
    done, todo = [], [np.arange(len(pivots))]
    while todo:
        part = todo.pop()
        if len(part) <= most:
            done.append(part)
            continue
        spread = pivots[part] - pivots[part].mean(axis=0)
        along = spread @ np.linalg.svd(spread, full_matrices=False)[2][0]
        order = part[np.argsort(along, kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return done


def unit(rows: np.ndarray, kind: type = np.float32) -> np.ndarray:
    wide = rows.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # very large and very small values would overflow when squared
    return (wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))).astype(kind)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether two bytes hold each value of a batch, next to what stands beside the vectors."""
    for batch in batches:
        values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        with np.errstate(over="ignore"):
            halves = bool((np.isnan(values) | (values.astype(np.float16) == values)).all())
        yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(np.full(batch.num_rows, halves))], ["hash", "halves"])


def _first(given: DataFrame, code: Code) -> DataFrame:
    """``id, packed``: of each id the vector of its earliest arrival, the smallest of several."""
    at = given.schema["at"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("at"), code.pack(batch.column("vector"))], ["id", "at", "packed"])

    coded = given.mapInArrow(each, f"id string, at {at}, packed binary")
    return coded.groupBy("id").agg(F.min(F.struct("at", "packed")).alias("first")).select("id", "first.packed")


def fit(given: DataFrame, n: int, code: Code, pivots: int | None = None, probes: int | None = None, seed: int = 5) -> Index:
    """Choose pivots: a random sample without repetition, of at most ``MAX_PIVOTS`` vectors."""
    count, sample = min(pivots or default_pivots(n), MAX_PIVOTS), min(SAMPLE, n // ONE_IN)
    most = max(count, sample)
    hashed = F.xxhash64("id", F.lit(seed))
    # Of the ids so many that enough of them have vectors that count; all where there are few.
    share = (2 * most + 1000) / max(1, n)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (batch for batch, _ in code.count(batches))

    def drawn_from(some: DataFrame) -> list:
        classes = _first(some, code).mapInArrow(each, "id string, packed binary").groupBy("packed").agg(F.min("id").alias("id"))
        return classes.orderBy(hashed, "id").limit(most).select("packed").collect()

    rows = drawn_from(given.where(hashed < int((share - 0.5) * 2**64))) if share < 1 else []
    if len(rows) < most:  # a small table, or one where few vectors count
        rows = drawn_from(given)
    if not rows:
        nothing = np.empty((0, 0), np.float32)
        return Index(nothing, 0, np.empty(0, np.int64), nothing)
    drawn = unit(code.unpack(pa.array([bytes(r.packed) for r in rows])))
    chosen = drawn[:count]
    tasks = given.sparkSession.sparkContext.defaultParallelism
    shelves = shelve(chosen, max(1, math.ceil(len(chosen) / max(1, math.ceil(n / BLOCK), min(2 * tasks, n // SMALL)))))
    starts = np.cumsum([0] + [len(x) for x in shelves[:-1]])
    return Index(chosen[np.concatenate(shelves)], probes or default_probes(len(chosen), n), starts, drawn[:sample])


def _nearest(index: Index, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Part by part of unit vectors: which they are, and their cosines with the pivots."""
    step = max(256, CELLS // len(index.pivots))
    for low in range(0, len(rows), step):
        part = slice(low, min(len(rows), low + step))
        yield part, rows[part] @ index.pivots.T


def _least(index: Index, rows: np.ndarray, k: int) -> np.ndarray:
    """A bound that each row's k-th best cosine does not fall below; the row itself may be in the sample, so one more is counted."""
    if len(index.sample) <= 4 * k:
        return np.full(len(rows), -2.0, np.float32)
    parts = [np.partition(part @ index.sample.T, len(index.sample) - k - 1, axis=1)[:, len(index.sample) - k - 1] for part in np.array_split(rows, max(1, len(rows) // 1000))]
    # A little less, as these products may round otherwise than those in the files.
    return np.concatenate(parts).astype(np.float32) - np.float32(1e-5)


@dataclass(frozen=True)
class Store:
    """Vectors by shelf, sorted by file, vector and id, in ``folder``.

    Of exact copies the k + 1 smallest ids are heads, all that a top k can need
    of them; the rest lies apart. ``sizes``: the heads of each shelf.
    """

    folder: str
    sizes: np.ndarray
    rests: frozenset[int]

    @property
    def before(self) -> np.ndarray:
        """The number of each shelf's first head; the others follow."""
        return np.cumsum(self.sizes) - self.sizes

    def read(self, shelf: int, columns: list[str], head: bool = True) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(self.folder)
        files = system.get_file_info(fs.FileSelector(f"{path}/head={str(head).lower()}/shelf={shelf}", allow_not_found=True))
        for file in sorted(x.path for x in files if x.path.endswith(".parquet")):
            with system.open_input_file(file) as opened:
                yield from pq.ParquetFile(opened).iter_batches(READ, columns=columns)


def post(first: DataFrame, k: int, index: Index, code: Code) -> Store:
    """Write each vector once, to its shelf."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in code.count(batches):
            home = np.concatenate([near.argmax(axis=1) for _, near in _nearest(index, unit(rows))] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(index.shelf(home)), pa.array(home.astype(np.int32)), *batch.columns], ["shelf", "file", "id", "packed"])

    spark = first.sparkSession
    parts = min(20_000, max(spark.sparkContext.defaultParallelism, len(index.starts)))
    shelved = first.mapInArrow(each, "shelf int, file int, id string, packed binary").repartition(parts, "shelf")
    place = F.row_number().over(W.partitionBy("shelf", "file", "packed").orderBy("id"))
    placed = shelved.withColumn("place", place).withColumn("head", F.col("place") <= k + 1)
    folder = f"{shared_dir(spark)}/neighbours-{uuid.uuid4().hex}"
    placed.sortWithinPartitions("head", "shelf", "file", "packed", "id").write.partitionBy("head", "shelf").option("compression", "zstd").parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    sizes, rests = np.zeros(len(index.starts), np.int64), set()
    for r in spark.read.schema("place int, head boolean, shelf int").parquet(folder).groupBy("head", "shelf").count().collect():
        if r.head:
            sizes[r.shelf] = r["count"]
        else:
            rests.add(r.shelf)
    return Store(folder, sizes, frozenset(rests))


def _blocks(sizes: np.ndarray, most: int) -> list[list[tuple[int, int, int]]]:
    """Blocks of about ``most`` queries at most: shelves side by side, or a part of a large one (shelf, part, of how many)."""
    blocks, room = [], 0
    for shelf in np.flatnonzero(sizes):
        n = int(sizes[shelf])
        parts = math.ceil(n / most)
        if parts == 1 and n <= room:
            blocks[-1].append((int(shelf), 0, 1))
            room -= n
        else:
            blocks += [[(int(shelf), p, parts)] for p in range(parts)]
            room = most - n if parts == 1 else 0
    return blocks


FOUND = "item string, other string, cosine double"


def _best(cosine: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k columns of each row with the greatest cosines, with their names."""
    if cosine.shape[1] <= k:
        return cosine, names
    top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    return np.take_along_axis(cosine, top, axis=1), np.take_along_axis(names, top, axis=1)


def _spread(cosine: np.ndarray, name: np.ndarray, r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values listed by row (``r`` ascending) as a matrix of ``n`` rows, filled up with -2."""
    counts = np.bincount(r, minlength=n)
    place = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
    found, which = np.full((n, int(counts.max(initial=0))), -2.0, np.float32), np.zeros((n, int(counts.max(initial=0))), np.int64)
    found[r, place], which[r, place] = cosine, name
    return found, which


class _Queries:
    """A block of queries with the best found so far for each: ``cosines``, and the numbers of their first heads as ``names``."""

    def __init__(self, store: Store, index: Index, code: Code, k: int, block: list[tuple[int, int, int]]) -> None:
        self.store, self.index, self.code, self.k, self.block = store, index, code, k, block
        nums, rows = [], []
        for shelf, part, parts in block:
            low, high = (store.before[shelf] + store.sizes[shelf] * p // parts for p in (part, part + 1))
            for at, _, vectors in self.entries(shelf):
                mine = (at >= low) & (at < high)
                nums.append(at[mine])
                rows.append(vectors[mine])
        self.num, self.rows = np.concatenate(nums), np.concatenate(rows)
        self.cosines = np.repeat(_least(index, self.rows, k)[:, None], k, axis=1)
        self.names = np.full((len(self.num), k), -1, np.int64)
        self.reach = np.empty(len(self.num), np.float32)
        self.looks = np.zeros(len(index.starts), np.int64)
        probes = min(index.probes, len(index.pivots))
        for part, near in _nearest(index, self.rows):
            self.reach[part] = np.partition(near, near.shape[1] - probes, axis=1)[:, near.shape[1] - probes]
            self.looks += (np.maximum.reduceat(near, index.starts, axis=1) >= self.reach[part, None]).sum(axis=0)
        # A little more, as these products may round otherwise than those the reach was taken from.
        self.reach -= np.float32(1e-6)

    def entries(self, shelf: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Number, file and unit vector of each distinct vector of a shelf."""
        before = int(self.store.before[shelf])
        for batch in self.store.read(shelf, ["file", "packed", "place"]):
            at = np.flatnonzero(np.asarray(batch.column("place")) == 1)
            if len(at):
                yield before + at, np.asarray(batch.column("file"))[at], unit(self.code.unpack(batch.column("packed").take(pa.array(at))))
            before += batch.num_rows

    def search(self) -> None:
        """Look into the shelves, those first that most look into, as what is found there rules more of the others out."""
        for shelf in np.argsort(-self.looks, kind="stable"):
            if self.looks[shelf]:
                for known, file, vectors in self.entries(int(shelf)):
                    self.compare(known, file, vectors)

    def compare(self, known: np.ndarray, file: np.ndarray, vectors: np.ndarray) -> None:
        files, lows = np.unique(file, return_index=True)
        highs = np.append(lows[1:], len(file))
        for low in range(0, len(self.num), max(1, CELLS // len(files))):
            here = slice(low, low + max(1, CELLS // len(files)))
            probed = ((self.rows[here] @ self.index.pivots[files].T) >= self.reach[here, None]).T.copy()
            for a, b, looks in zip(lows, highs, probed):
                looking = low + np.flatnonzero(looks)
                turned = vectors[a:b].T.copy()
                for start in range(0, len(looking), max(1, CELLS // (b - a))):
                    self.improve(looking[start : start + max(1, CELLS // (b - a))], known[a:b], turned)

    def improve(self, at: np.ndarray, known: np.ndarray, turned: np.ndarray) -> None:
        cosine = self.rows[at] @ turned
        own = np.minimum(np.searchsorted(known, self.num[at]), len(known) - 1)
        mine = np.flatnonzero(known[own] == self.num[at])
        cosine[mine, own[mine]] = -2.0
        r, c = np.divmod(np.flatnonzero((cosine > self.cosines[at].min(axis=1)[:, None]).ravel()), len(known))
        if len(r):
            # Only queries that something better was found for are ranked again.
            got, r = np.unique(r, return_inverse=True)
            found, which = _spread(cosine[got[r], c], known[c], r, len(got))
            at = at[got]
            self.cosines[at], self.names[at] = _best(np.hstack([self.cosines[at], found]), np.hstack([self.names[at], which]), self.k)

    def heads(self) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
        """The numbers of the vectors asked or found, ascending; where the ids of each begin, and where the last end; these ids; these vectors."""
        wanted = np.unique(np.append(self.names[self.names >= 0], self.num))
        ids, counts, vectors = [], [], []
        shelf = np.searchsorted(self.store.before, wanted, "right") - 1
        for s in np.unique(shelf):
            read = pa.Table.from_batches(self.store.read(int(s), ["id", "packed", "place"])).combine_chunks()
            first = np.flatnonzero(np.asarray(read["place"]) == 1)
            start = wanted[shelf == s] - self.store.before[s]
            many = np.append(first, read.num_rows)[np.searchsorted(first, start) + 1] - start
            counts.append(many)
            rows = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())
            ids.append(read["id"].chunk(0).take(pa.array(rows)))
            vectors.append(read["packed"].chunk(0).take(pa.array(start)))
        return wanted, np.append(0, np.cumsum(np.concatenate(counts))), pa.concat_arrays(ids), pa.concat_arrays(vectors)

    def answers(self) -> Iterator[pa.RecordBatch]:
        """The k best others of each id, with their cosines in full precision."""
        wanted, ends, ids, vectors = self.heads()
        many = np.diff(ends)
        full = {}
        for low in range(0, len(self.num), 4096):
            names = self.names[low : low + 4096]
            own, place = np.searchsorted(wanted, self.num[low : low + 4096]), np.searchsorted(wanted, np.maximum(names, wanted[0]))
            here, at = np.unique(np.hstack([own[:, None], place]), return_inverse=True)
            rows = unit(self.code.unpack(vectors.take(pa.array(here))), np.float64)[at.reshape(len(own), -1)]
            cosines = np.clip(np.einsum("qd,qkd->qk", rows[:, 0], rows[:, 1:]), -1, 1)
            # Without copies the best are what was found.
            plain = (many[own] == 1) & ((many[place] == 1) | (names < 0)).all(axis=1)
            r, c = np.nonzero((names >= 0) & plain[:, None])
            yield self.batch(ids.take(pa.array(ends[own[r]])), ids.take(pa.array(ends[place[r, c]])), cosines[r, c])
            rows = []
            for q in np.flatnonzero(~plain):
                mine = ids[ends[own[q]] : ends[own[q] + 1]].to_pylist()
                lent = [(-float(cosines[q, c]), x) for c in np.flatnonzero(names[q] >= 0) for x in ids[ends[place[q, c]] : ends[place[q, c] + 1]].to_pylist()]
                best = sorted([(-1.0, x) for x in mine] + lent)[: self.k + 1]
                rows += [(x, *b) for x in mine for b in [b for b in best if b[1] != x][: self.k]]
                if len(mine) > self.k:
                    full[int(self.num[low + q])] = best[: self.k]
            yield self.listed(rows)
        yield from self.rest(full)

    def rest(self, full: dict[int, list[tuple[float, str]]]) -> Iterator[pa.RecordBatch]:
        """The same for copies that are not heads, whose vectors have ``full`` lists."""
        for shelf in {shelf for shelf, _, _ in self.block} & self.store.rests:
            lists, before = {}, int(self.store.before[shelf])
            for batch in self.store.read(shelf, ["packed", "place"]):
                for at in np.flatnonzero(np.asarray(batch.column("place")) == 1):
                    if before + int(at) in full:
                        lists[batch.column("packed")[int(at)].as_py()] = full[before + int(at)]
                before += batch.num_rows
            for batch in self.store.read(shelf, ["packed", "id"], head=False):
                for low in range(0, batch.num_rows, 4096):
                    part = batch.slice(low, 4096)
                    yield self.listed([(x, *b) for p, x in zip(part.column("packed").to_pylist(), part.column("id").to_pylist()) for b in lists.get(p, ())])

    def listed(self, rows: list[tuple[str, float, str]]) -> pa.RecordBatch:
        return self.batch(pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), -np.array([r[1] for r in rows], np.float64))

    def batch(self, item: pa.Array, other: pa.Array, cosine: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([item, other, pa.array(cosine)], ["item", "other", "cosine"])


def search(store: Store, k: int, index: Index, code: Code, spark) -> DataFrame:
    """``item, other, cosine``: the k best others the index finds for each of the stored ids."""
    tasks = spark.sparkContext.defaultParallelism
    blocks = _blocks(store.sizes, max(1, min(QUERIES, math.ceil(store.sizes.sum() / (2 * tasks)))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                queries = _Queries(store, index, code, k, blocks[number])
                if len(queries.num):
                    queries.search()
                    yield from queries.answers()

    return spark.range(0, len(blocks), 1, max(1, len(blocks))).mapInArrow(each, FOUND)


def most_similar(
    vectors: DataFrame, k: int = 10, id_col: str = "chunk_id", vector: str = "vector", dimension: int = 64, arrived: str | None = "arrived_at",
    pivots: int | None = None, probes: int | None = None, seed: int = 5,
) -> DataFrame:
    """``item, other, cosine``: the k most similar other records of every record, by cosine.

    A record's vector is that of its earliest arrival (of several the smallest).
    Only vectors of ``dimension`` finite values that are not all zero count;
    null ids, null, shorter and longer vectors give nothing. Exact copies are
    searched as one and then given each other: of copies in excess, and of equal
    cosines, the smallest ids win. An empty table gives no rows.

    The result reads the vectors by shelf from a folder of ``spark.checkpoint.dir``,
    which is removed when the driver ends.
    """
    spark = vectors.sparkSession
    given = vectors.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), (F.col(arrived) if arrived else F.lit(0)).alias("at"), F.col(vector).cast("array<float>").alias("vector")
    )
    # The number is that of different vectors, near enough to choose numbers of pivots and probes by.
    looked = given.select(F.xxhash64("vector").alias("hash"), "vector").mapInArrow(_exact, "hash long, halves boolean")
    n, halves = looked.agg(F.approx_count_distinct("hash", 0.01), F.bool_and("halves")).first()
    code = Code(dimension, 2 if halves else 4)
    index = fit(given, n, code, pivots, probes, seed)
    if not len(index.pivots):
        return spark.createDataFrame([], FOUND)
    return search(post(_first(given, code), k, index, code), k, index, code, spark)
