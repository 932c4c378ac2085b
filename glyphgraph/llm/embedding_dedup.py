"""Near-duplicate embeddings: a navigable small-world graph per shard, every shard queried, components of the links.

Equal vectors are one class. Classes are dealt to shards by a hash. A shard's graph holds balls: a vector within half
the linking angle of a node that it meets while it is inserted joins that node's ball, whose centre then stands for
its members. Every pair of shards is one task, in which the balls of one are searched in the graph of the other. Part
of the queries, and points turned away from known balls by up to the linking angle, are compared with all balls as
an audit; beams are widened until it finds enough of them, and those of single queries until they reach past the
farthest ball that could matter.

Two balls close enough for all their members to be linked, or too far apart for any, are settled by the angle between
their centres and their radii, and a member and a ball likewise; what lies between is compared vector by vector, in
double precision. So a crowd of near copies costs as many steps as it has members, and links are counted, never listed:
a task returns the number of links per class, and one edge for each ball that it found connected to another.

Vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows without vec_id, link with nothing.
Vectors link only with those of the same width. Every row counts as a vector: rows that share a vec_id are told apart,
and each comes back. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import materialize
from .components import components
from .small_world import SmallWorld, build

LEAST_COSINE = 0.9
# Shards: at least so many, and as many as keep each within so many bytes of vectors.
LEAST_SHARDS, SHARD_BYTES = 4, 32 << 20
# The first width of beams, the share of links that an audit has to find, and the queries and turned points audited.
BEAM, AUDIT_RECALL, AUDITED = 16, 0.995, 256
# What rounding may do to an angle.
_SLACK = 1e-6
# Vectors compared at a time, per side.
_PIECE = 1 << 11

_GRAPH = (
    "width int, shard long, names binary, twins binary, copies binary, vectors binary, starts binary,"
    " layers array<binary>, entry long"
)
_FOUND = "vec_id long, twin long, links long, to_id long, to_twin long"


def _fine(vector: str):
    """Whether a vector takes part."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _unit(flat: np.ndarray, width: int) -> np.ndarray:
    rows = flat.reshape(-1, width).astype(np.float64)
    # scaled first, so that squares neither overflow nor vanish
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


class Shard:
    """The classes of a shard in the order of their balls, and the graph over the balls.

    `flat` holds the vectors as they were stored; `starts` where each ball begins.
    """

    def __init__(self, names, twins, copies, flat, width, starts, layers, entry):
        self.names, self.twins, self.copies = names, twins, copies
        self.flat, self.starts = flat, starts
        self.vectors = _unit(flat, width)
        sizes = np.diff(starts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        # a ball of one is its vector, exactly
        self.centres = self.vectors[starts[:-1]].copy()
        crowds = np.flatnonzero(sizes > 1)
        if len(crowds):
            sums = np.add.reduceat(self.vectors, starts[:-1], axis=0)[crowds]
            self.centres[crowds] = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        far = _angles(np.einsum("nd,nd->n", self.vectors, self.centres[owner]))
        far[sizes[owner] == 1] = 0
        self.radii = np.maximum.reduceat(far, starts[:-1])
        self.world = SmallWorld(self.centres.astype(np.float32), layers, entry)
        self.links = np.zeros(len(names), dtype=np.int64)

    @staticmethod
    def build(names: np.ndarray, twins: np.ndarray, copies: np.ndarray, flat: np.ndarray, width: int, limit: float) -> Shard:
        world = build(_unit(flat, width), math.cos(limit / 2))
        order = np.argsort(world.owner, kind="stable")
        starts = np.searchsorted(world.owner[order], np.arange(len(world.points) + 1))
        flat = flat.reshape(-1, width)[order].ravel()
        return Shard(names[order], twins[order], copies[order], flat, width, starts, world.layers, world.entry)

    def row(self) -> list:
        arrays = [self.names, self.twins, self.copies, self.flat, self.starts]
        return [np.ascontiguousarray(a).tobytes() for a in arrays] + [[x.tobytes() for x in self.world.layers], self.world.entry]

    @staticmethod
    def of(row: dict) -> Shard:
        names, twins, copies, starts = (np.frombuffer(row[c], np.int64) for c in ("names", "twins", "copies", "starts"))
        single = len(row["vectors"]) == 4 * len(names) * row["width"]
        flat = np.frombuffer(row["vectors"], np.float32 if single else np.float64)
        layers = [np.frombuffer(layer, np.int32).reshape(len(starts) - 1, -1) for layer in row["layers"]]
        return Shard(names, twins, copies, flat, row["width"], starts, layers, row["entry"])


def _within(points: np.ndarray, centres: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (point, centre) whose similarity is at least the point's floor, by comparing every pair, in pieces."""
    found = []
    for low in range(0, len(points), _PIECE):
        for start in range(0, len(centres), _PIECE):
            near = points[low : low + _PIECE] @ centres[start : start + _PIECE].T >= floors[low : low + _PIECE, None]
            a, b = np.nonzero(near)
            found.append((a + low, b + start))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def _searched(world: SmallWorld, points: np.ndarray, floors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The (point, node) that searches find at or above the floors, each beam as wide as its point needs."""
    pending, found = np.arange(len(points)), []
    while len(pending):
        beam = min(beam, len(world.points))
        nodes, near = world.search(points[pending], beam)
        floor = floors[pending, None]
        # the last of a full beam is within reach still: there may be more
        short = (near[:, -1] >= floor[:, 0]) & (beam < len(world.points))
        a, b = np.nonzero((near >= floor) & (nodes >= 0) & ~short[:, None])
        found.append((pending[a], nodes[a, b]))
        pending, beam = pending[short], 4 * beam
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def _audited_beam(world: SmallWorld, points: np.ndarray, floors: np.ndarray, limit: float, beam: int) -> int:
    """The beam at which searches find enough of what comparing with all nodes finds."""
    rng = np.random.default_rng(len(points))
    some = rng.permutation(len(points))[:AUDITED]
    base = world.points[rng.integers(0, len(world.points), AUDITED)].astype(np.float64)
    away = rng.standard_normal(base.shape)
    away -= np.einsum("nd,nd->n", away, base)[:, None] * base
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    angle = rng.random((AUDITED, 1)) * limit
    turned = (np.cos(angle) * base + np.sin(angle) * away).astype(np.float32)
    probes = np.concatenate([points[some], turned])
    floor = np.concatenate([floors[some], np.full(AUDITED, math.cos(limit), np.float32)])
    size = len(world.points)
    truth = np.unique(np.stack(_within(probes, world.points, floor)), axis=1)
    while beam < size:
        found = np.stack(_searched(world, probes, floor, beam))
        hits = len(np.intersect1d(truth[0] * size + truth[1], found[0] * size + found[1]))
        if hits >= AUDIT_RECALL * truth.shape[1]:
            break
        beam *= 2
    return beam


def near_balls(a: Shard, b: Shard, limit: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The (ball of a, ball of b) that may hold linked members, as far as audited searches find them."""
    points = a.centres.astype(np.float32)
    floors = np.cos(np.minimum(limit + a.radii + b.radii.max() + 1e-3, math.pi)).astype(np.float32)
    beam = _audited_beam(b.world, points, floors, limit, beam)
    if beam >= len(b.world.points):
        return _within(points, b.world.points, floors)
    return _searched(b.world, points, floors, beam)


def count_links(a: Shard, b: Shard, limit: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Count the links between two shards, or within one, on both; the balls that are connected, as pairs."""
    same = a is b
    left, right = near_balls(a, b, limit)
    if same:
        left, right = np.minimum(left, right), np.maximum(left, right)
        # a ball meets itself whether or not a search came by
        left, right = np.concatenate([left, np.arange(len(a.radii))]), np.concatenate([right, np.arange(len(a.radii))])
        left, right = np.unique(np.stack([left, right]), axis=1)
    cosine = np.concatenate(
        [np.einsum("nd,nd->n", a.centres[left[i : i + _PIECE]], b.centres[right[i : i + _PIECE]]) for i in range(0, len(left), _PIECE)]
        or [np.empty(0)]
    )
    angle, radius = _angles(cosine), a.radii[left] + b.radii[right]
    angle[same & (left == right)] = 0
    single = (np.diff(a.starts)[left] == 1) & (np.diff(b.starts)[right] == 1)
    all_linked = np.where(single, cosine >= least, angle + radius <= limit - _SLACK)
    none_linked = np.where(single, cosine < least, angle > limit + radius + _SLACK)
    joined = all_linked.copy()
    own = same & (left == right)
    weight_a, weight_b = np.add.reduceat(a.copies, a.starts[:-1]), np.add.reduceat(b.copies, b.starts[:-1])
    # balls that are linked whole: every member gains the other ball
    gain_a, gain_b = np.zeros(len(a.radii), np.int64), np.zeros(len(b.radii), np.int64)
    whole = all_linked & ~own
    np.add.at(gain_a, left[whole], weight_b[right[whole]])
    np.add.at(gain_b, right[whole], weight_a[left[whole]])
    inner = all_linked & own
    np.add.at(gain_a, left[inner], weight_a[left[inner]])
    a.links += np.repeat(gain_a, np.diff(a.starts))
    b.links += np.repeat(gain_b, np.diff(b.starts))
    for place in np.flatnonzero(~all_linked & ~none_linked):
        joined[place] = _compare(a, b, int(left[place]), int(right[place]), limit, least, bool(own[place]))
    return left[joined], right[joined]


def _compare(a: Shard, b: Shard, ball: int, other: int, limit: float, least: float, own: bool) -> bool:
    """Count the links between the members of two balls, or of one; whether there is any."""
    mine, theirs = np.arange(a.starts[ball], a.starts[ball + 1]), np.arange(b.starts[other], b.starts[other + 1])
    if own:
        first, second = np.zeros(len(mine), bool), np.zeros(len(mine), bool)
    else:
        # members that are linked with the whole of the other ball, or with none of it
        angle = _angles(a.vectors[mine] @ b.centres[other])
        first, second = angle + b.radii[other] <= limit - _SLACK, angle > limit + b.radii[other] + _SLACK
    whole, any_link = mine[first], bool(first.any())
    a.links[whole] += b.copies[theirs].sum()
    b.links[theirs] += a.copies[whole].sum()
    rest = mine[~first & ~second]
    for low in range(0, len(rest), _PIECE):
        some = rest[low : low + _PIECE]
        for start in range(0, len(theirs), _PIECE):
            others = theirs[start : start + _PIECE]
            linked = a.vectors[some] @ b.vectors[others].T >= least
            if own:
                linked |= some[:, None] == others[None, :]
            any_link |= bool(linked.any())
            a.links[some] += linked @ b.copies[others]
            if not own:
                b.links[others] += a.copies[some] @ linked
    return any_link


def _edges(a: Shard, b: Shard, left: np.ndarray, right: np.ndarray) -> Iterator[tuple]:
    """Edges that connect what the pairs of balls connect, no more than there are balls."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sides = (a, b)
    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        one, two = find((0, x)), find((0 if a is b else 1, y))
        if one != two:
            root[two] = one
            ends = [(int(sides[s].names[sides[s].starts[k]]), int(sides[s].twins[sides[s].starts[k]])) for s, k in (one, two)]
            yield ends[0][0], ends[0][1], None, ends[1][0], ends[1][1]


def _counted(shard: Shard, own: bool) -> Iterator[tuple]:
    """The links that a task counted, by class; the other members of a ball are connected to its first one."""
    for i in np.flatnonzero(shard.links).tolist():
        yield int(shard.names[i]), int(shard.twins[i]), int(shard.links[i]), None, None
    if own:
        for begin, end in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist(), strict=True):
            for i in range(begin + 1, end):
                yield int(shard.names[begin]), int(shard.twins[begin]), None, int(shard.names[i]), int(shard.twins[i])


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["vec_id", "twin", "links", "to_id", "to_twin"])


def near_duplicates(vectors: DataFrame, *, vector: str = "embedding", least: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links of a cosine of `least` or more, one row per row of `vectors`."""
    limit = math.acos(least)
    kind = vectors.schema[vector].dataType.elementType
    # single precision stays as it is until a task compares; everything else is compared as doubles
    stored = "array<float>" if kind.typeName() in ("float", "byte", "short") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast(stored).alias("vector"))
    tagged = rows.withColumn("fine", _fine("vector"))
    clean = tagged.where("fine").select("vec_id", "vector")
    classes = clean.groupBy("vector").agg(F.min("vec_id").alias("name"), F.count("*").alias("copies"))
    # classes that share their smallest vec_id have different twins
    classes = materialize(classes.withColumn("twin", F.monotonically_increasing_id()), "vector-classes")
    size = classes.agg(F.sum(F.size("vector").cast("long") * 8)).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    dealt = classes.withColumn("width", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)))

    def graph(table: pa.Table) -> pa.Table:
        width, shard = table["width"][0].as_py(), table["shard"][0].as_py()
        flat = table["vector"].combine_chunks().flatten().to_numpy()
        ids = [table[c].to_numpy() for c in ("name", "twin", "copies")]
        row = [width, shard, *Shard.build(*ids, flat, width, limit).row()]
        schema = pa.schema(
            [("width", pa.int32()), ("shard", pa.int64())]
            + [(c, pa.binary()) for c in ("names", "twins", "copies", "vectors", "starts")]
            + [("layers", pa.list_(pa.binary())), ("entry", pa.int64())]
        )
        return pa.table([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    graphs = materialize(dealt.groupBy("width", "shard").applyInArrow(graph, _GRAPH), "vector-graphs")

    def compare(table: pa.Table) -> pa.Table:
        sides = [Shard.of(row) for row in table.sort_by("shard").to_pylist()]
        first, second = table["first"][0].as_py(), table["second"][0].as_py()
        if len(sides) < (1 if first == second else 2):
            return _table([])
        a, b = sides[0], sides[-1]
        found = list(_edges(a, b, *count_links(a, b, limit, least)))
        found += _counted(a, first == second)
        if a is not b:
            found += _counted(b, False)
        return _table(found)

    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    pairs = graphs.withColumn("other", other)
    pairs = pairs.withColumns({"first": F.least("shard", "other"), "second": F.greatest("shard", "other")}).drop("other")
    found = materialize(pairs.groupBy("width", "first", "second").applyInArrow(compare, _FOUND), "vector-links")
    links = found.where("links is not null").groupBy("vec_id", "twin").agg(F.sum("links").alias("links"))
    node, to = F.struct("vec_id", "twin"), F.struct(F.col("to_id").alias("vec_id"), F.col("to_twin").alias("twin"))
    connected = components(found.where("to_id is not null").select(node.alias("a"), to.alias("b")))
    # a class counts itself with all its copies, so a vector's links are one less
    key = [F.col("name") == F.col("vec_id"), F.col("class_twin") == F.col("twin")]
    named = classes.select("vector", "name", F.col("twin").alias("class_twin"))
    named = named.join(links.hint("merge"), key, "left").drop("vec_id", "twin")
    root = connected.select(F.col("id.vec_id").alias("id"), F.col("id.twin").alias("id_twin"), F.col("component.vec_id").alias("root"))
    named = named.join(root.hint("merge"), [F.col("name") == F.col("id"), F.col("class_twin") == F.col("id_twin")], "left")
    answer = named.select("vector", (F.col("links") - 1).alias("n_links"), F.coalesce("root", "name").alias("component_id"))
    linked = clean.join(answer.hint("merge"), "vector").select("vec_id", "n_links", "component_id")
    alone = tagged.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
