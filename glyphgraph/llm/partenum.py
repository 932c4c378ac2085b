"""N-gram Jaccard join by PartEnum signatures, exact at the given similarity.

Sets of word shingles are put into bands by size; a set also joins the band below when a partner could be
there. In a band, two similar sets differ in at most k shingles. Shingles are dealt by hash into n1 parts of
three pieces each, very common shingles left out; with n1 above k / 2 some part differs in at most one shingle, so two of its three pieces
are equal in both sets: every pair of pieces gives a signature, and the sets share one. Sets with too many
empty pieces for that also give the shingles of their prefix as signatures, which similar sets share as well.

Sets that share a signature make a group. Frequent passages put many unlike sets into one, so its members first
compare sketches: the numbers of shingles in each of a few cells by hash, of which no two sets have more in common
than the lesser number in every cell. Sets whose sketches allow a link, directly or by way of others, make a cluster.
Each set is sent to its cluster once, or to several blocks of bounded size if the cluster is large, and every two sets
of a cluster are compared exactly in some block; what a block gives back are fewer links than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.storage import materialize
from .arrays import LOWER, chunks, id_array, ids_of, mix, packed, sequence_hashes, span_hashes, text_arrays, unpacked, word_bounds
from .components import components
from .shards import FOUND, Found, pack_found, runs, with_found
from .sizing import text_buckets

SHINGLE = 5
# Two sets link when OF * |intersection| >= SIMILAR * |union|.
SIMILAR, OF = 80, 100

_BAND_GROWTH = 1.5
_SLACK = 0.3
_SIGNATURE_BYTES = 5

# A shingle is common when about one in COMMON_SHARE documents or more has it. Leaving shingles out never
# makes two sets differ more, so any choice gives the same links; MOST_COMMON bounds what tasks are sent.
COMMON_SHARE = 200
MOST_COMMON = 1 << 16
_BLOCK = 1200
# Sketches that are compared at once.
_SKETCH_BLOCK = 8192
_COLUMNS = 1024

_SENT = "bucket int, docs binary, prints binary, counts binary, signatures binary"
_GROUPS = "shard long, sizes binary, members binary"
_SETS = "doc_id long, n_shingles long, one long, two long, sketch binary, is_set boolean"


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted within each, and where each text's begin."""
    data, starts = text_arrays(column)
    data = LOWER[data]
    begins, ends, before = word_bounds(data, starts)
    words = span_hashes(data, begins, ends)
    counts = np.diff(before)
    hashes = sequence_hashes(words, shingle)
    owner = np.repeat(np.arange(len(column)), counts)[: len(hashes)]
    inside = np.arange(len(hashes)) + shingle <= before[1:][owner]
    hashes, owner = hashes[inside], owner[inside]
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(short):
        # the whole sequence, told apart from longer ones by its length
        whole = [sequence_hashes(words[before[i] : before[i] + counts[i]], int(counts[i]))[0] for i in short]
        hashes = np.concatenate([hashes, np.array(whole, np.uint64) ^ mix(counts[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(column) + 1))


def _prints(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each set, which do not depend on the order."""
    made = []
    for seed in (11, 12):
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(mix(hashes ^ np.uint64(seed)), out=sums[1:])
        made.append(mix(sums[edges[1:]] - sums[edges[:-1]]).view(np.int64))
    return made[0], made[1]


def _cells(sizes: np.ndarray) -> np.ndarray:
    """The cells of a sketch: a power of two, two to four shingles each."""
    return 1 << np.maximum(3, np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64) - 1)


def sketches(hashes: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """For each set how many of its shingles lie in every cell, 255 at most."""
    sizes = np.diff(edges)
    cells = _cells(sizes)
    ends = np.cumsum(cells)
    at = mix(hashes ^ np.uint64(13)) & np.repeat(cells - 1, sizes).astype(np.uint64)
    counts = np.bincount(at.astype(np.int64) + np.repeat(ends - cells, sizes), minlength=int(ends[-1]) if len(ends) else 0)
    counts = np.minimum(counts, 255).astype(np.uint8)
    return [packed(counts[end - n : end]) for end, n in zip(ends.tolist(), cells.tolist(), strict=True)]


def may_link(sizes: np.ndarray, made: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Links of sets with some earlier one that hold together all whose sketches allow them to be similar."""
    counts = [np.frombuffer(m, np.uint8) for m in made]
    least = min(len(c) for c in counts)
    # a cell of fewer ones is the sum of those whose numbers end alike
    held = np.stack([c if len(c) == least else c.reshape(-1, least).sum(axis=0, dtype=np.uint32) for c in counts])
    # shingles that a full cell does not count may be in both
    rest = sizes - held.sum(axis=1, dtype=np.int64)
    left = np.arange(len(sizes))
    while len(left):
        meeting, left = [left[0]], left[1:]
        while meeting and len(left):
            one = meeting.pop()
            both = np.minimum(held[one], held[left]).sum(axis=1, dtype=np.int64) + np.minimum(rest[one], rest[left])
            both = np.minimum(both, np.minimum(sizes[one], sizes[left]))
            linked = (OF + SIMILAR) * both >= SIMILAR * (sizes[one] + sizes[left])
            if linked.any():
                yield one, left[linked]
                meeting.extend(left[linked])
                left = left[~linked]


def band_edges(largest: int) -> list[int]:
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, int(edges[-1] * _BAND_GROWTH)))
    return edges


def signatures(hashes: np.ndarray, edges: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All signatures and the sets they belong to. `common` are the (sorted) shingles to pass over."""
    hot = np.isin(hashes, common)
    # common shingles last in each set, so that a prefix holds them only if it must
    order = np.lexsort((hashes, hot, np.repeat(np.arange(len(edges) - 1), np.diff(edges))))
    hashes, hot = hashes[order], hot[order]
    sizes = np.diff(edges)
    bands = np.array(band_edges(int(sizes.max(initial=1))))
    band = np.searchsorted(bands, sizes, side="right") - 1
    made, owners = [], []
    least = -(-sizes * SIMILAR // OF)
    for back in range(len(bands)):
        # the smaller of two similar sets decides on the band; it has at least `least` shingles
        members = np.flatnonzero((sizes > 0) & (band - back >= 0) & ((back == 0) | (least < bands[band - back + 1])))
        if not len(members):
            break
        own = band[members] - back
        # |A union B| - |A intersection B| <= (OF / SIMILAR - 1) |A| for the smaller set A
        most = (bands[own + 1] - 1) * (OF - SIMILAR) // SIMILAR
        halves = most // 2
        parts = halves + 1 + np.ceil(halves * _SLACK).astype(np.int64)
        offset = np.concatenate([[0], np.cumsum(parts)])
        n = sizes[members]
        element = np.repeat(edges[members] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        values, row = hashes[element], np.repeat(np.arange(len(members)), n)
        place = mix(values + np.uint64(101))
        part = (place % parts[row].astype(np.uint64)).astype(np.int64)
        piece = (place >> np.uint64(40)).astype(np.int64) % 3
        cell = ((offset[row] + part) * 3 + piece)[~hot[element]]
        sums = np.zeros(int(offset[-1]) * 3, dtype=np.uint64)
        np.add.at(sums, cell, mix(values[~hot[element]] + np.uint64(202)))
        filled = (np.bincount(cell, minlength=len(sums)) > 0).reshape(-1, 3)
        sums = sums.reshape(-1, 3)
        of_row = np.repeat(np.arange(len(members)), parts)
        in_row = np.arange(len(of_row)) - offset[of_row]
        for left_out in range(3):
            a, b = (left_out + 1) % 3, (left_out + 2) % 3
            name = (own[of_row] << 34 | in_row << 2 | left_out).astype(np.uint64)
            value = mix(mix(sums[:, a] + name) + sums[:, b])
            some = filled[:, a] | filled[:, b]
            made.append(value[some])
            owners.append(members[of_row[some]])
        # parts with two empty pieces may be the only ones that two sets agree on
        bad = np.bincount(of_row[filled.sum(axis=1) < 2], minlength=len(members))
        unsure = parts - halves <= bad
        if unsure.any():
            # overlap is at least `least`, so the first n - least + 1 shingles of either set meet
            rank = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            chosen = unsure[row] & (rank <= (n - least[members])[row])
            made.append(mix(values[chosen] + mix(own[row[chosen]].astype(np.uint64) + np.uint64(303))))
            owners.append(members[row[chosen]])
    if not made:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(made), np.concatenate(owners)


def ngram_components(docs: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """The component of every document: (doc_id, n_shingles, component_id), one row per row.

    `docs` has doc_id and text; other columns are ignored. A document's set has the distinct shingles of
    `shingle` words of its text with A-Z lower-cased; with fewer words the whole sequence; NULL, empty and
    blank texts have none and link with nothing. `component_id` is the smallest doc_id reachable by links.
    Rows that share a doc_id are one node of the graph. Rows without doc_id are compared with nothing, and
    their component_id is NULL.
    """
    source = docs.select(F.col("doc_id").cast("long"), "text")
    buckets = text_buckets(source)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            hashes, edges = shingle_sets(part.column("text"), shingle)
            one, two = _prints(hashes, edges)
            names = ["doc_id", "n_shingles", "one", "two", "sketch", "is_set"]
            sketched = pa.array(sketches(hashes, edges), pa.binary())
            arrays = [part.column("doc_id"), pa.array(np.diff(edges)), pa.array(one), pa.array(two), sketched]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([True] * part.num_rows, pa.bool_())], names)
            # in the same pass: how many texts of the slice have its most frequent shingles
            values, counts = np.unique(hashes, return_counts=True)
            frequent = counts >= max(3, part.num_rows // (2 * COMMON_SHARE))
            n = int(frequent.sum())
            none = pa.nulls(n, pa.int64())
            arrays = [none, pa.array(counts[frequent]), pa.array(values[frequent].view(np.int64)), none, pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([False] * n, pa.bool_())], names)

    described = materialize(source.mapInArrow(describe, _SETS), "sets")
    sketched = described.where("is_set and doc_id is not null and n_shingles > 0")
    sketched = sketched.select("doc_id", "n_shingles", "sketch").distinct()
    sets = described.where("is_set").drop("is_set", "sketch")
    frequent = described.where("not is_set").groupBy("one").agg(F.sum("n_shingles").alias("n"))
    frequent = frequent.where(F.col("n") * COMMON_SHARE >= max(sets.count(), 1000)).orderBy(F.desc("n"), "one").limit(MOST_COMMON)
    common = np.sort(np.array([r["one"] for r in frequent.collect()], dtype=np.int64).view(np.uint64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            part = part.filter(part.column("doc_id").is_valid())
            ids = ids_of(part.column("doc_id"))
            part = part.take(pa.array(np.argsort(ids, kind="stable")))
            hashes, edges = shingle_sets(part.column("text"), shingle)
            one, _ = _prints(hashes, edges)
            # equal sets have equal signatures: the smallest document of a slice speaks for them
            _, first = np.unique(one, return_index=True)
            speaks = np.zeros(len(one), dtype=bool)
            speaks[first] = True
            sizes = np.diff(edges)
            spoken = np.concatenate([[0], np.cumsum(sizes * speaks)])
            made, owner = signatures(hashes[np.repeat(speaks, sizes)], spoken, common)
            if len(made):
                yield _dealt(made, owner, np.sort(ids), one, buckets)

    def group(table: pa.Table) -> pa.Table:
        return _shared(table, buckets)

    def distinct_groups(table: pa.Table) -> pa.Table:
        sizes, members = unpacked(table["sizes"], np.int64), unpacked(table["members"], np.int64)
        found = {m.tobytes() for m in np.split(members, np.cumsum(sizes)[:-1])} if len(sizes) else set()
        return pa.table({"members": pa.array([np.frombuffer(m, np.int64) for m in found], pa.list_(pa.int64()))})

    groups = materialize(
        source.mapInArrow(scan, _SENT)
        .groupBy("bucket")
        .applyInArrow(group, _GROUPS)
        .groupBy("shard")
        .applyInArrow(distinct_groups, "members array<long>"),
        "groups",
    )

    def gather(texts: pa.Table, found: pa.Table) -> pa.Table:
        wanted = np.unique(Found(found, np.int64).docs)
        ids, blobs = [], []
        for part in chunks(texts.to_batches()):
            part = part.filter(pa.array(np.isin(ids_of(part.column("doc_id")), wanted)))
            if not part.num_rows:
                continue
            hashes, edges = shingle_sets(part.column("text"), shingle)
            ids.extend(ids_of(part.column("doc_id")).tolist())
            blobs.extend(packed(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True))
        return pa.table({"doc_id": id_array(ids), "shingles": pa.array(blobs, pa.binary())})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.unique(ids_of(batch.column("id")))
            yield from pack_found(ids, ids, buckets).to_batches()

    members = groups.select(
        F.xxhash64("members").alias("name"), F.size("members").alias("n"), F.posexplode("members").alias("place", "id")
    )
    blocks = F.explode(_blocks(F.col("place"), F.col("n") - 1, _SKETCH_BLOCK)).alias("block")
    met = members.select("name", blocks, "id").join(sketched.hint("merge"), F.col("id") == F.col("doc_id"))
    met = met.select(F.pmod(F.xxhash64("name", "block"), F.lit(buckets)).alias("shard"), F.hash("block").alias("block"), "name", "id", "n_shingles", "sketch")
    stars = materialize(met.groupBy("shard").applyInArrow(_sketched_links, "a long, b long").distinct(), "stars")
    clusters = materialize(components(stars), "clusters")
    asked = clusters.select("id").mapInArrow(ask, FOUND)
    shingles = materialize(
        with_found(source, asked, buckets, gather, "doc_id long, shingles binary").dropDuplicates(["doc_id"]),
        "candidates",
    )

    blocks = _in_blocks(clusters).join(shingles.hint("merge"), F.col("id") == F.col("doc_id"))
    inside = blocks.select("name", "block", "id", "shingles").groupBy("name", "block")
    edges = materialize(inside.applyInArrow(_compare_block, "a long, b long"), "edges")
    linked = components(edges)
    # rows whose sets are equal are one class, known by its smallest document
    prints = sets.where("doc_id is not null and n_shingles > 0").groupBy("n_shingles", "one", "two")
    classes = materialize(prints.agg(F.min("doc_id").alias("class_id")), "classes")
    linked = linked.select(F.col("id").alias("class_id"), "component")
    named = classes.join(linked.hint("merge"), "class_id", "left").select(
        "n_shingles", "one", "two", F.coalesce("component", "class_id").alias("component_id")
    )
    joined = sets.join(named.hint("merge"), ["n_shingles", "one", "two"], "left")
    alone = F.col("doc_id").isNull() | F.col("component_id").isNull()
    return joined.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _in_blocks(clusters: DataFrame) -> DataFrame:
    """Members by block: (name, block, id). Every two members of a cluster meet in a block of bounded size."""
    place = (F.row_number().over(W.partitionBy("component").orderBy("id")) - 1).cast("long")
    placed = clusters.select(F.col("component").alias("name"), "id", place.alias("place"))
    last = placed.groupBy("name").agg(F.max("place").alias("last"))
    blocks = F.explode(_blocks(F.col("place"), F.col("last"), _BLOCK)).alias("block")
    return placed.join(last.hint("merge"), "name").select("name", blocks, "id")


def _blocks(place: Column, last: Column, size: int) -> Column:
    """The blocks that a place goes to: every two stretches of `size` places up to the last one share a block."""
    own, end = (F.floor(p / size) for p in (place, last))
    return F.transform(
        F.sequence(F.lit(0).cast("long"), end),
        lambda other: F.struct(F.least(own, other).alias("low"), F.greatest(own, other).alias("high")),
    )


def _sketched_links(table: pa.Table) -> pa.Table:
    """Links (a, b) that hold together the members of every group and block whose sketches allow it."""
    names, blocks = table["name"].to_numpy(), table["block"].to_numpy()
    ids, sizes, made = table["id"].to_numpy(), table["n_shingles"].to_numpy(), table["sketch"].to_pylist()
    order = np.lexsort((ids, blocks, names))
    edges = np.flatnonzero((np.diff(names[order]) != 0) | (np.diff(blocks[order]) != 0)) + 1
    found = set()
    for part in np.split(order, edges):
        for one, others in may_link(sizes[part], [made[i] for i in part.tolist()]):
            found.update((int(ids[part[one]]), b) for b in ids[part[others]].tolist())
    links = np.array([(min(p), max(p)) for p in found if p[0] != p[1]], np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1])})


def _compare_block(table: pa.Table) -> pa.Table:
    """Links that hold a block's members together as their sets do: (a, b), fewer than it has members."""
    ids = table["id"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
    sizes = np.array([len(s) for s in sets])
    _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[token] > 1
    row, token = row[shared], np.unique(token[shared], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(token.max(initial=-1)) + 1, _COLUMNS):
        part = (token >= low) & (token < low + _COLUMNS)
        held = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        held[row[part], token[part] - low] = 1
        both += held @ held.T
    links = OF * both >= SIMILAR * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(links, True)
    root = np.arange(len(sets))
    while True:
        lowest = np.where(links, root[None, :], len(sets)).min(axis=1)
        if (lowest == root).all():
            break
        root = lowest
    tied = np.flatnonzero(root != np.arange(len(sets)))
    a, b = ids[root[tied]], ids[tied]
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _dealt(made: np.ndarray, owner: np.ndarray, ids: np.ndarray, one: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = ((made >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((owner, bucket))
    rows = []
    for begin, n in zip(*runs(bucket[order]), strict=True):
        part = order[begin : begin + n]
        first, counts = runs(owner[part])
        who = owner[part][first]
        short = made[part].view(np.uint8).reshape(-1, 8)[:, :_SIGNATURE_BYTES]
        rows.append((int(bucket[part[0]]), packed(ids[who]), packed(one[who]), packed(counts), packed(short)))
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "docs", "prints", "counts", "signatures"])


def _shared(table: pa.Table, shards: int) -> pa.Table:
    """The groups of different sets that share a signature, each in the order of its documents."""
    docs, prints = unpacked(table["docs"], np.int64), unpacked(table["prints"], np.int64)
    counts = unpacked(table["counts"], np.int64)
    short = unpacked(table["signatures"], np.uint8).reshape(-1, _SIGNATURE_BYTES)
    wide = np.zeros((len(short), 8), dtype=np.uint8)
    wide[:, :_SIGNATURE_BYTES] = short
    values = wide.view(np.uint64).ravel()
    who = np.repeat(np.arange(len(docs)), counts)
    order = np.argsort(values, kind="stable")
    begins, sizes = runs(values[order])
    several = np.flatnonzero(sizes > 1)
    found = set()
    for begin, n in zip(begins[several].tolist(), sizes[several].tolist(), strict=True):
        members = who[order[begin : begin + n]]
        own, first = docs[members], np.argsort(docs[members], kind="stable")
        _, kept = np.unique(prints[members][first], return_index=True)
        if len(kept) > 1:
            found.add(np.sort(own[first][kept]).tobytes())
    lists = [np.frombuffer(f, np.int64) for f in found]
    by_shard: dict[int, list[np.ndarray]] = {}
    for members in lists:
        by_shard.setdefault(int(members[0]) % shards, []).append(members)
    return pa.table(
        {
            "shard": pa.array(list(by_shard), pa.int64()),
            "sizes": pa.array([packed(np.array([len(m) for m in g])) for g in by_shard.values()], pa.binary()),
            "members": pa.array([packed(np.concatenate(g)) for g in by_shard.values()], pa.binary()),
        }
    )
