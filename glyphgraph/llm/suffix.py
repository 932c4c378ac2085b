"""Suffix-array deduplication: bytes covered by a long string that starts somewhere else too.

Two equal strings of `length` bytes have the same minimizer: the `gram`-byte piece inside with the smallest
hash. So texts are cut into blocks, each a run of windows with one minimizer, and only blocks whose minimizer
occurs again are compared, all those of a minimizer in one place. There the collection is built column by
column from the right: each round puts one symbol of every block in front, sorts the blocks' suffixes anew
by that symbol alone (the column of the Burrows-Wheeler transform), and updates the common prefix of
neighbours. Equal windows stand at the same distance from the minimizer, so one column decides on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, ids_of, packed, rolling_hashes, text_arrays, unpacked
from .shards import FOUND, Found, pack_found, runs, with_found
from .sizing import text_buckets
from .substring import SENT, deal, sent_batch, sent_entries

LENGTH = 200
GRAM = 32

# A text is searched for minimizers in stretches of this many windows, so a place fits in _PLACE_BITS.
_STRETCH = 1 << 23
_PLACE_BITS = np.uint64(24)



def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of `width` values, in three passes."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def blocks_of(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: (key, text, first byte, end byte, place of the minimizer)."""
    pieces = [_stretch(data, starts, low, length, gram) for low in range(0, max(1, len(data)), _STRETCH)]
    return tuple(np.concatenate(p) for p in zip(*pieces, strict=True))


def _stretch(data: np.ndarray, starts: np.ndarray, low: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    data = data[low : low + _STRETCH + length - 1]
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none, none
    places = np.arange(len(data) - gram + 1)
    hashes = rolling_hashes(data, places, places + gram)
    # the leftmost of equal hashes wins, so the choice depends on the window's bytes alone
    tagged = (hashes >> _PLACE_BITS) << _PLACE_BITS | places.astype(np.uint64)
    best = sliding_min(tagged, length - gram + 1) & np.uint64((1 << int(_PLACE_BITS)) - 1)
    owner = np.searchsorted(starts, low + np.arange(len(best)), side="right") - 1
    windows = np.flatnonzero(low + np.arange(len(best)) + length <= starts[owner + 1])
    if not len(windows):
        return none.astype(np.uint64), none, none, none, none
    place, text = best[windows].astype(np.int64), owner[windows]
    change = np.concatenate(
        [[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (windows[1:] != windows[:-1] + 1)]
    )
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(windows)) - 1
    return hashes[place[first]], text[first], low + windows[first], low + windows[last] + length, low + place[first]


def repeated_windows(
    blocks: list[bytes], groups: np.ndarray, anchors: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Marks, over the bytes of all blocks, where a window starts that another block of the group has.

    Also returns where each block begins in the marks. `anchors` are the places that stand in one column.
    """
    sizes = np.array([len(b) for b in blocks], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    symbols = np.frombuffer(b"".join(blocks), dtype=np.uint8)
    marks = np.zeros(len(symbols), dtype=bool)
    if not len(blocks):
        return marks, offsets
    left, right = -anchors, sizes - anchors
    by_end = np.argsort(-right, kind="stable")
    ends = right[by_end]
    # blocks in the order of (group, suffix), and the common prefix of each with the one before
    order, common = np.empty(0, np.int64), np.empty(0, np.int64)
    entered = 0
    for column in range(int(ends[0]) - 1, int(left.min()) - 1, -1):
        upto = int(np.searchsorted(-ends, -(column + 1), side="right"))
        if upto > entered:
            # blocks that end here have an empty suffix, which stands before all others
            order = np.concatenate([by_end[entered:upto], order])
            common = np.concatenate([np.zeros(upto - entered, np.int64), common])
            if upto - entered < len(common):
                common[upto - entered] = 0
            entered = upto
        places = np.flatnonzero(left[order] <= column)
        if not len(places):
            order, common = order[:0], common[:0]
            continue
        rows = order[places]
        key = groups[rows] * 256 + symbols[offsets[rows] + column - left[rows]]
        sort = np.argsort(key, kind="stable")
        places, order, key = places[sort], rows[sort], key[sort]
        same = np.flatnonzero(key[1:] == key[:-1])
        fresh = np.zeros(len(order), dtype=np.int64)
        if len(same):
            bounds = np.stack([places[same] + 1, places[same + 1] + 1], axis=1).ravel()
            between = np.minimum.reduceat(np.append(common, 0), bounds)[::2]
            fresh[same + 1] = np.minimum(between + 1, length)
        common = fresh
        long = common >= length
        long[:-1] |= long[1:]
        found = order[long]
        marks[offsets[found] + column - left[found]] = True
    return marks, offsets


def _merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs from intervals sorted by their beginning."""
    if not len(spans):
        return spans
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def remove_repeated_bytes(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Remove repeated strings: (doc_id, n_bytes, n_removed, removed, kept), one row per row.

    `docs` has doc_id and text (as UTF-8 bytes; NULL counts as empty); other columns are ignored. A byte goes
    if a string of `length` bytes covers it that also starts anywhere else, in this text or another; strings
    never cross texts and are judged on the input. `removed` has the maximal intervals [begin, end), `kept`
    the remaining bytes. Copies remove each other whole, so ties need no rule. Rows should have a doc_id of
    their own: those that share one, or have none, are each given the intervals of them all.
    """
    source = docs.select(F.col("doc_id").cast("long"), "text")
    buckets = text_buckets(source)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            keys, text, *_ = blocks_of(*text_arrays(part.column("text")), length, gram)
            if not len(keys):
                continue
            owners = ids_of(part.column("doc_id"))[text]
            by_key = np.argsort(keys, kind="stable")
            begins, counts = runs(keys[by_key])
            first = np.sort(by_key[begins])
            again = np.sort(by_key[np.repeat(counts > 1, counts)])
            yield sent_batch(
                [*deal(keys[first], owners[first], False, buckets), *deal(keys[again], owners[again], True, buckets)]
            )

    def count(table: pa.Table) -> pa.Table:
        keys, owners = sent_entries(table, False)
        order = np.argsort(keys, kind="stable")
        _, counts = runs(keys[order])
        shared = order[np.repeat(counts > 1, counts)]
        sure_keys, sure_owners = sent_entries(table, True)
        return pack_found(
            np.concatenate([owners[shared], sure_owners]), np.concatenate([keys[shared], sure_keys]), buckets
        )

    shared_keys = source.mapInArrow(scan, SENT).groupBy("bucket").applyInArrow(count, FOUND)

    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        known = Found(found, np.uint64)
        made = [b for part in chunks(texts.to_batches()) for b in _cut_blocks(part, known, length, gram, buckets)]
        return pa.Table.from_batches(made, _BLOCKS)

    def compare(table: pa.Table) -> pa.Table:
        return _compare_blocks(table, length, buckets)

    blocks = with_found(source, shared_keys, buckets, cut, _BLOCKS_SCHEMA)
    spans = blocks.groupBy("bucket").applyInArrow(compare, FOUND)

    def remove(texts: pa.Table, found: pa.Table) -> pa.Table:
        known = Found(found, np.int64, 2)
        return pa.Table.from_batches([_without_spans(p, known) for p in chunks(texts.to_batches())], _KEPT)

    return with_found(source, spans, buckets, remove, _KEPT_SCHEMA)


_BLOCKS = pa.schema(
    [("bucket", pa.int32())]
    + [(n, pa.binary()) for n in ("keys", "docs", "starts", "anchors", "sizes", "bytes", "sure")]
)
_BLOCKS_SCHEMA = "bucket int, keys binary, docs binary, starts binary, anchors binary, sizes binary, bytes binary, sure binary"
_KEPT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("removed", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
        ("kept", pa.binary()),
    ]
)
_KEPT_SCHEMA = "doc_id long, n_bytes long, n_removed long, removed array<struct<begin:long,end:long>>, kept binary"


def _without_spans(part: pa.RecordBatch, found: Found) -> pa.RecordBatch:
    made = []
    for text, spans in zip(part.column("text"), found.of(ids_of(part.column("doc_id"))), strict=True):
        data = (text.as_py() or "").encode()
        spans = np.minimum(_merged(spans[np.argsort(spans[:, 0], kind="stable")]), len(data))
        spans = spans[spans[:, 0] < spans[:, 1]]
        inner = [0, *spans.ravel().tolist(), len(data)]
        kept = b"".join(data[a:b] for a, b in zip(inner[::2], inner[1::2], strict=True))
        made.append((len(data), len(data) - len(kept), [{"begin": a, "end": b} for a, b in spans.tolist()], kept))
    columns = list(zip(*made, strict=True))
    arrays = [pa.array(c, f.type) for c, f in zip(columns, list(_KEPT)[1:], strict=True)]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], schema=_KEPT)


def _cut_blocks(
    part: pa.RecordBatch, found: Found, length: int, gram: int, buckets: int
) -> Iterator[pa.RecordBatch]:
    """The blocks of a slice whose minimizer is shared, equal ones once; what repeats here is sure."""
    data, starts = text_arrays(part.column("text"))
    keys, text, first, end, anchor = blocks_of(data, starts, length, gram)
    if not len(keys):
        return
    ids, whole = ids_of(part.column("doc_id")), data.tobytes()
    edges = np.searchsorted(text, np.arange(part.num_rows + 1)).tolist()
    wanted = np.zeros(len(keys), dtype=bool)
    for row, shared in enumerate(found.of(ids)):
        low, high = edges[row], edges[row + 1]
        if low < high and len(shared):
            wanted[low:high] = np.isin(keys[low:high], shared.ravel())
    seen: dict[tuple[int, bytes], int] = {}
    rows, sure = [], []
    for i in np.flatnonzero(wanted).tolist():
        low = int(starts[text[i]])
        a, b = int(first[i]), int(end[i])
        content, doc = (int(keys[i]), whole[a:b]), int(ids[text[i]])
        bucket = (int(keys[i]) >> 20) % buckets
        if content in seen:
            known = rows[seen[content]]
            sure.append((bucket, doc, a - low, b - low))
            sure.append((bucket, known[2], known[3], known[3] + len(known[5])))
        else:
            seen[content] = len(rows)
            rows.append((bucket, int(keys[i]), doc, a - low, int(anchor[i]) - a, content[1]))
    by_bucket: dict[int, tuple[list, list]] = {}
    for row in rows:
        by_bucket.setdefault(row[0], ([], []))[0].append(row)
    for row in sure:
        by_bucket.setdefault(row[0], ([], []))[1].append(row[1:])
    made = []
    for bucket, (own, settled) in by_bucket.items():
        columns = list(zip(*own, strict=True)) if own else [()] * 6
        made.append(
            (
                bucket,
                packed(np.array(columns[1], np.uint64)),
                packed(np.array(columns[2], np.int64)),
                packed(np.array(columns[3], np.int64)),
                packed(np.array(columns[4], np.int64)),
                packed(np.array([len(x) for x in columns[5]], np.int64)),
                b"".join(columns[5]),
                packed(np.array(settled, np.int64)),
            )
        )
    if made:
        columns = list(zip(*made, strict=True))
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _BLOCKS, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=_BLOCKS)


def _compare_blocks(table: pa.Table, length: int, shards: int) -> pa.Table:
    """The intervals of all documents in which a bucket's blocks repeat one another."""
    keys, docs = unpacked(table["keys"], np.uint64), unpacked(table["docs"], np.int64)
    starts, anchors = unpacked(table["starts"], np.int64), unpacked(table["anchors"], np.int64)
    sizes, sure = unpacked(table["sizes"], np.int64), unpacked(table["sure"], np.int64).reshape(-1, 3)
    ends = np.cumsum(sizes)
    content = b"".join(table["bytes"].to_pylist())
    out_docs, out_begins, out_ends = sure[:, 0].tolist(), sure[:, 1].tolist(), sure[:, 2].tolist()

    # equal blocks repeat one another whole, so the columns need one of each
    classes: dict[tuple[int, bytes], list[int]] = {}
    for i, (key, end, size) in enumerate(zip(keys.tolist(), ends.tolist(), sizes.tolist(), strict=True)):
        classes.setdefault((key, content[end - size : end]), []).append(i)
    for members in classes.values():
        if len(members) > 1:
            for i in members:
                out_docs.append(int(docs[i]))
                out_begins.append(int(starts[i]))
                out_ends.append(int(starts[i] + sizes[i]))

    _, group, counts = np.unique(
        np.array([k for k, _ in classes], dtype=np.uint64), return_inverse=True, return_counts=True
    )
    several = np.flatnonzero(counts[group] > 1) if len(classes) else np.empty(0, np.int64)
    names, lists = list(classes), list(classes.values())
    chosen = [lists[c][0] for c in several]
    marks, offsets = repeated_windows(
        [names[c][1] for c in several], group[several].astype(np.int64), anchors[chosen], length
    )
    for n, i in enumerate(chosen):
        own = marks[offsets[n] : offsets[n + 1]]
        for a, b in np.flatnonzero(np.diff(np.concatenate([[0], own, [0]]))).reshape(-1, 2).tolist():
            out_docs.append(int(docs[i]))
            out_begins.append(int(starts[i]) + a)
            out_ends.append(int(starts[i]) + b - 1 + length)
    spans = np.stack([np.array(out_begins, np.int64), np.array(out_ends, np.int64)], axis=1)
    return pack_found(np.array(out_docs, np.int64), spans, shards)
