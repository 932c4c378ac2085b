"""Nearest neighbours by inner product: multiprobe p-stable hashing, then exact reranking.

Vectors are scaled to at most length one and given one more component that makes all lengths equal, so the
largest inner product is the smallest distance. Each table hashes them by several projections on Gaussian
(2-stable) directions, cut into cells. A query visits buckets around its own, those first that most likely
hold neighbours: by the sum of its squared distances to the cells' borders. What its buckets hold is compared
in double precision on the original vectors, and the candidates of all tables are merged. Equal vectors are
one entry, which keeps the smallest of its ids, as many as an answer can need. A query whose buckets hold fewer
candidates than it asks for is compared with all vectors, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.storage import materialize
from .shards import runs

TABLES, HASHES, PROBES, CELL = 4, 5, 420, 1.0
NEIGHBOURS = 20
BLOCK_VECTORS = 1 << 20
# A search multiplies at most so many vectors by so many queries at a time.
PIECE_ROWS, PIECE_PAIRS = 1 << 12, 1 << 16

_OFFSETS = np.array(list(product(range(-2, 3), repeat=HASHES)))
_PACK = "slot long, rows int, tables binary, keys binary, names binary, vectors binary"


def _clean(frame: DataFrame, vector: str) -> DataFrame:
    """(vec_id, vector) as doubles; NULL, zero, and vectors holding NULL or non-finite components take no part."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists(x, lambda v: v != 0)
    return frame.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector")).where(fine & some & F.col("vec_id").isNotNull())


class Hasher:
    """The tables' directions, the same in every task."""

    def __init__(self, width: int, longest: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.longest = longest
        self.directions = rng.standard_normal((TABLES, HASHES, width + 1))
        self.shifts = rng.random((TABLES, HASHES)) * CELL

    def _projected(self, vectors: np.ndarray, table: int) -> np.ndarray:
        scaled = vectors / self.longest
        last = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))
        whole = np.concatenate([scaled, last[:, None]], axis=1)
        return (whole @ self.directions[table].T + self.shifts[table]) / CELL

    def keys(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return _key(np.floor(self._projected(vectors, table)).astype(np.int64))

    def probes(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """The keys of the PROBES likeliest buckets of each vector."""
        place = self._projected(vectors, table)
        cell = np.floor(place).astype(np.int64)
        inside = place - cell
        steps = np.arange(-2, 3)
        # distance to the near border of the cell that many steps away
        gap = np.where(steps > 0, steps - inside[..., None], np.where(steps < 0, inside[..., None] - steps - 1, 0))
        cost = sum((gap[:, h, :] ** 2)[:, _OFFSETS[:, h] + 2] for h in range(HASHES))
        best = np.argpartition(cost, PROBES - 1, axis=1)[:, :PROBES]
        return _key(cell[:, None, :] + _OFFSETS[best])


def _key(cells: np.ndarray) -> np.ndarray:
    key = np.zeros(cells.shape[:-1], dtype=np.int64)
    for h in range(cells.shape[-1]):
        key = key << 12 | (cells[..., h] & 0xFFF)
    return key


def _packs(slots: np.ndarray, tables: np.ndarray, keys: np.ndarray, names: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(slots, kind="stable")
    cuts = np.flatnonzero(np.diff(slots[order])) + 1
    parts = [p for p in np.split(order, cuts) if len(p)]
    columns = [
        pa.array([int(slots[p[0]]) for p in parts], pa.int64()),
        pa.array([len(p) for p in parts], pa.int32()),
        *(pa.array([np.ascontiguousarray(a[p]).tobytes() for p in parts], pa.binary()) for a in (tables, keys, names, vectors)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["slot", "rows", "tables", "keys", "names", "vectors"])


def _unpack(table: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    whole = [b"".join(table[c].to_pylist()) for c in ("tables", "keys", "names", "vectors")]
    a, b, c = (np.frombuffer(x, np.int64) for x in whole[:3])
    return a, b, c, np.frombuffer(whole[3], np.float64).reshape(-1, width)


def _slots(tables: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The coarse place of a bucket: its table, and a quarter of its first two cells.

    Buckets that one query visits lie within two cells of its own, so it meets at most four places of a table,
    however much data or however many partitions there are.
    """
    return tables << 20 | (keys >> 12 * HASHES - 10 & 0x3FF) << 10 | keys >> 12 * HASHES - 22 & 0x3FF


def nearest(
    vectors: DataFrame, *, vector: str = "embedding", query_step: int = 20, neighbours: int = NEIGHBOURS
) -> DataFrame:
    """The nearest of every query: (query_id, rank, vec_id, score), at most `neighbours` rows each.

    Queries are the rows whose vec_id is divisible by `query_step`; candidates are all other rows. NULL ids
    and vectors that are NULL, zero, of another width than most (of equally frequent ones the smallest), or hold NULL
    or non-finite components take no part. Ties go to the smaller vec_id. Rows that share a vec_id and a vector
    count once.
    """
    clean = materialize(_clean(vectors, vector), "vectors")
    widths = clean.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"))
    most = widths.orderBy(F.desc("n"), "width").first()
    width = most["width"] if most else 1
    clean = clean.where(F.size("vector") == width)
    keep = neighbours + 1

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, width) + 0.0
            groups: dict[bytes, list[int]] = {}
            for i, row in zip(ids.tolist(), rows, strict=True):
                groups.setdefault(row.tobytes(), []).append(i)
            few = [sorted(set(g))[:keep] for g in groups.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.binary()), pa.array(few, pa.list_(pa.int64()))], ["vector", "ids"])

    found = clean.mapInArrow(collapse, "vector binary, ids array<long>").groupBy("vector")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    classes = materialize(found.agg(ids.alias("ids")).select("vector", "ids", F.col("ids")[0].alias("name")), "classes")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(-1, width) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["query_id", "vector"])

    asked = clean.where(F.col("vec_id") % query_step == 0).mapInArrow(keyed, "query_id long, vector binary").distinct()
    asked = materialize(asked.join(classes.select("vector", "name").hint("merge"), "vector"), "queries")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))
    size = clean.agg(F.max(length).alias("longest"), F.count("*").alias("n")).first()
    hasher = Hasher(width, size["longest"] or 1.0)
    blocks = -(-size["n"] // BLOCK_VECTORS) or 1

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, width)
            for table in range(TABLES):
                keys, tables = hasher.keys(rows, table), np.full(len(rows), table)
                yield _packs(_slots(tables, keys) * blocks + names % blocks, tables, keys, names, rows)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = np.frombuffer(b"".join(part.column(1).to_pylist()), np.float64).reshape(-1, width)
                who = np.repeat(np.arange(len(rows)), PROBES)
                for table in range(TABLES):
                    keys, tables = hasher.probes(rows, table).ravel(), np.full(len(who), table)
                    slot = _slots(tables, keys)
                    for block in range(blocks):
                        # a place gets each query's vector once, with the list of its probes
                        yield _probe_packs(slot * blocks + block, tables, keys, who, part.column(0).to_numpy(), rows)

    def search(entries: pa.Table, probes: pa.Table) -> pa.Table:
        return _search(entries, probes, width, keep)

    left = classes.select("name", "vector").mapInArrow(index, _PACK).groupBy("slot")
    queries = asked.select("name", "vector").distinct()
    right = queries.mapInArrow(probe, "slot long, tables binary, keys binary, names binary, whose binary, vectors binary")
    merged = left.cogroup(right.groupBy("slot")).applyInArrow(search, "asked long, name long, score double")
    # the same candidate may come from several tables; all computed its score from the same two vectors
    best = merged.groupBy("asked", "name").agg(F.max("score").alias("score"))
    order = W.partitionBy("asked").orderBy(F.col("score").desc(), "name")
    best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    asks = asked.select("query_id", F.col("name").alias("asked"))

    def answered(best: DataFrame, asks: DataFrame) -> DataFrame:
        spread = best.join(classes.select("name", F.explode("ids").alias("vec_id")).hint("merge"), "name")
        answers = asks.join(spread.select("asked", "vec_id", "score"), "asked")
        rank = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        ranked = answers.where("vec_id <> query_id").withColumn("rank", F.row_number().over(rank))
        return ranked.where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")

    found = materialize(answered(best, asks), "answers")
    # as many as there are: ids of copies beyond those that an entry keeps are not needed for this
    others = classes.select(F.explode("ids").alias("vec_id")).distinct().limit(neighbours + 1).count() - 1
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = asks.join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < min(neighbours, others))
    short = materialize(short.select("query_id", "asked"), "short-queries")
    if short.limit(1).count() == 0:
        return found
    rest = answered(_compared_with_all(classes, queries.join(short.select(F.col("asked").alias("name")).distinct(), "name"), size["n"], width, keep), short)
    return found.join(short.select("query_id").hint("merge"), "query_id", "left_anti").unionByName(rest)


# Vectors of a block when queries are compared with all of them.
SCAN_VECTORS = 1 << 14


def _compared_with_all(classes: DataFrame, queries: DataFrame, rows: int, width: int, keep: int) -> DataFrame:
    """(asked, name, score): the best `keep` entries of every query (name, vector), from all entries, in blocks."""
    blocks = -(-rows // SCAN_VECTORS)
    left = classes.select("name", "vector", F.pmod(F.xxhash64("name"), F.lit(blocks)).alias("block"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    right = queries.select("name", "vector", every.alias("block"))

    def scan(entries: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if entries.num_rows:
            names, vectors = entries["name"].to_numpy(), _rows_of(entries["vector"], width)
            asks, points = asked["name"].to_numpy(), _rows_of(asked["vector"], width)
            for i in range(len(asks)):
                # the score is computed as a search does it
                score = (vectors * points[i]).sum(axis=1)
                best = np.lexsort((names, -score))[:keep]
                found.append((np.full(len(best), asks[i]), names[best], score[best]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        return pa.table(columns, ["asked", "name", "score"])

    scanned = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(scan, "asked long, name long, score double")
    order = W.partitionBy("asked").orderBy(F.col("score").desc(), "name")
    return scanned.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).drop("place")


def _rows_of(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _probe_packs(slots, tables, keys, who, names, rows) -> pa.RecordBatch:
    order = np.argsort(slots, kind="stable")
    parts = [p for p in np.split(order, np.flatnonzero(np.diff(slots[order])) + 1) if len(p)]
    made = [[], [], [], [], [], []]
    for p in parts:
        own, local = np.unique(who[p], return_inverse=True)
        for column, value in zip(made[1:], (tables[p], keys[p], names[own], local.astype(np.int64), rows[own]), strict=True):
            column.append(np.ascontiguousarray(value).tobytes())
        made[0].append(int(slots[p[0]]))
    arrays = [pa.array(made[0], pa.int64()), *(pa.array(m, pa.binary()) for m in made[1:])]
    return pa.RecordBatch.from_arrays(arrays, ["slot", "tables", "keys", "names", "whose", "vectors"])


def _search(entries: pa.Table, probes: pa.Table, width: int, keep: int) -> pa.Table:
    """The best `keep` entries of every query among the buckets of a place that it visits.

    A bucket's vectors lie side by side and meet all its visitors in one product, in pieces of bounded size.
    What may be among a visitor's best is then scored by itself, the same way in every task.
    """
    none = pa.table({"asked": pa.array([], pa.int64()), "name": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not entries.num_rows or not probes.num_rows:
        return none
    tables, keys, names, rows = _unpack(entries, width)
    code = tables << 12 * HASHES | keys
    order = np.argsort(code, kind="stable")
    names, rows = names[order], rows[order]
    buckets, begins = np.unique(code[order], return_index=True)
    ends = np.append(begins[1:], len(order))

    tables, keys, asked, vectors = _unpack(probes.select(["tables", "keys", "names", "vectors"]), width)
    per_pack = [len(n) // 8 for n in probes["names"].to_pylist()]
    first = np.cumsum(per_pack) - per_pack
    who = np.concatenate([np.frombuffer(w, np.int64) + f for w, f in zip(probes["whose"].to_pylist(), first, strict=True)])
    wanted = tables << 12 * HASHES | keys
    place = np.minimum(np.searchsorted(buckets, wanted), len(buckets) - 1)
    hit = buckets[place] == wanted
    place, who = place[hit], who[hit]
    if not len(who):
        return none
    order = np.argsort(place, kind="stable")
    place, who = place[order], who[order]

    # what rounding can do to a score; the least that a query's next candidate must have
    slack = 1e-12 * np.linalg.norm(vectors, axis=1) * np.linalg.norm(rows, axis=1).max()
    least = np.full(len(asked), -np.inf)
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asks, finds = (np.concatenate(w) for w in zip(*waiting, strict=True))
        waiting.clear()
        score = np.concatenate([best[2], (rows[finds] * vectors[asks]).sum(axis=1)])
        asks, finds = np.concatenate([best[0], asks]), np.concatenate([best[1], finds])
        order = np.lexsort((names[finds], -score, asks))
        begin, size = runs(asks[order])
        rank = np.arange(len(order)) - np.repeat(begin, size)
        full = begin[size >= keep] + keep - 1
        least[asks[order[full]]] = score[order[full]] - slack[asks[order[full]]]
        order = order[rank < keep]
        return asks[order], finds[order], score[order]

    for begin, size in zip(*runs(place), strict=True):
        bucket, visitors = place[begin], who[begin : begin + size]
        for low in range(begins[bucket], ends[bucket], PIECE_ROWS):
            part = rows[low : min(low + PIECE_ROWS, ends[bucket])]
            for start in range(0, size, PIECE_PAIRS // len(part)):
                some = visitors[start : start + PIECE_PAIRS // len(part)]
                ask, find = np.nonzero(vectors[some] @ part.T >= least[some, None])
                waiting.append((some[ask], find + low))
                if sum(len(w[0]) for w in waiting) >= PIECE_PAIRS or len(waiting) >= 256:
                    best = settle()
    if waiting:
        best = settle()
    return pa.table({"asked": pa.array(asked[best[0]]), "name": pa.array(names[best[1]]), "score": pa.array(best[2])})
