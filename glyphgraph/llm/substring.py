"""Substring deduplication: words covered by a window of words that a document with a smaller id has too.

Every window of every text is hashed (Rabin-Karp over word hashes) and the hashes are counted in buckets by
hash. A task first settles what repeats inside a slice of its own input, so a window that millions of
documents share reaches its bucket once a slice. What comes back are the hashes to remove, by document; the
text itself is shuffled once, to meet them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import (
    chunks,
    ids_of,
    packed,
    sequence_hashes,
    span_hashes,
    text_arrays,
    unpacked,
    word_bounds,
)
from .shards import FOUND, Found, pack_found, runs, with_found
from .sizing import text_buckets

WINDOW = 13

SENT = "bucket int, sure boolean, docs binary, counts binary, hashes binary"


def window_hashes(column: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of every window, the text it is in, and the number of words before each text."""
    data, starts = text_arrays(column)
    begins, ends, before = word_bounds(data, starts)
    hashes = sequence_hashes(span_hashes(data, begins, ends), window)
    owner = np.repeat(np.arange(len(column)), np.diff(before))[: len(hashes)]
    inside = np.arange(len(hashes)) + window <= before[1:][owner]
    return hashes[inside], owner[inside], before


def deal(hashes: np.ndarray, docs: np.ndarray, sure: bool, buckets: int) -> Iterator[tuple]:
    """Rows of packed arrays, one a bucket, from hashes in the order of their documents."""
    bucket = ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for begin, n in zip(*runs(bucket[order]), strict=True):
        part = order[begin : begin + n]
        first, counts = runs(docs[part])
        yield int(bucket[part[0]]), sure, packed(docs[part][first]), packed(counts.astype(np.int32)), packed(hashes[part])


def sent_entries(table: pa.Table, sure: bool) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of `deal`: all hashes and their documents."""
    part = table.filter(pc.equal(table["sure"], sure))
    docs, counts = unpacked(part["docs"], np.int64), unpacked(part["counts"], np.int32)
    return unpacked(part["hashes"], np.uint64), np.repeat(docs, counts)


def sent_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    types = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "sure", "docs", "counts", "hashes"])


def remove_repeats(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Remove repeated windows: (doc_id, n_words, n_removed, removed, kept_text), one row per row.

    `docs` has doc_id and text; other columns are ignored. Words are runs of bytes outside [\\x20\\x09-\\x0D].
    A word goes if a window covers it whose words also start in a document with a smaller doc_id; windows
    are judged on the input. `removed` has the maximal intervals [begin, end) of removed word positions, and
    `kept_text` the other words joined by one space. NULL text counts as empty. A NULL doc_id counts as
    larger than all others; rows that share a doc_id (or have none) are one document to each other, so none
    of them loses a word to another. Ties cannot arise, as only a smaller doc_id counts.
    """
    source = docs.select(F.col("doc_id").cast("long"), "text")
    buckets = text_buckets(source)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            ids = ids_of(part.column("doc_id"))
            order = np.argsort(ids, kind="stable")
            hashes, owner, _ = window_hashes(part.column("text").take(pa.array(order)), window)
            if not len(hashes):
                continue
            owners = ids[order][owner]
            # equal hashes together, each group beginning with its smallest document
            by_hash = np.argsort(hashes, kind="stable")
            begins, counts = runs(hashes[by_hash])
            sorted_docs = owners[by_hash]
            later = sorted_docs > np.repeat(sorted_docs[begins], counts)
            first = np.sort(by_hash[begins])
            sure = np.sort(by_hash[later])
            rows = [*deal(hashes[first], owners[first], False, buckets), *deal(hashes[sure], owners[sure], True, buckets)]
            yield sent_batch(rows)

    def match(table: pa.Table) -> pa.Table:
        hashes, owners = sent_entries(table, False)
        order = np.lexsort((owners, hashes))
        begins, counts = runs(hashes[order])
        later = order[owners[order] > np.repeat(owners[order][begins], counts)]
        sure_hashes, sure_owners = sent_entries(table, True)
        return pack_found(
            np.concatenate([owners[later], sure_owners]), np.concatenate([hashes[later], sure_hashes]), buckets
        )

    found = source.mapInArrow(scan, SENT).groupBy("bucket").applyInArrow(match, FOUND)

    def remove(texts: pa.Table, found: pa.Table) -> pa.Table:
        known = Found(found, np.uint64)
        return pa.Table.from_batches(
            [_without_repeats(part, known, window) for part in chunks(texts.to_batches())], _KEPT
        )

    return with_found(source, found, buckets, remove, _KEPT_SCHEMA)


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


_KEPT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("removed", _SPANS),
        ("kept_text", pa.string()),
    ]
)
_KEPT_SCHEMA = (
    "doc_id long, n_words long, n_removed long, removed array<struct<begin:long,end:long>>, kept_text string"
)


def _without_repeats(part: pa.RecordBatch, found: Found, window: int) -> pa.RecordBatch:
    masks = _removed_words(part, found, window)
    made = []
    for row, text in enumerate(part.column("text")):
        words = (text.as_py() or "").encode().split()
        mask = masks.get(row)
        if mask is None:
            made.append((len(words), 0, [], b" ".join(words).decode()))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]))).reshape(-1, 2)
        kept = b" ".join(compress(words, ~mask)).decode()
        spans = [{"begin": a, "end": b} for a, b in edges.tolist()]
        made.append((len(words), int(mask.sum()), spans, kept))
    columns = list(zip(*made, strict=True))
    arrays = [pa.array(c, f.type) for c, f in zip(columns, list(_KEPT)[1:], strict=True)]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], schema=_KEPT)


def _removed_words(part: pa.RecordBatch, found: Found, window: int) -> dict[int, np.ndarray]:
    """For each row with hashes to remove, which of its words go."""
    wanted = {row: w.ravel() for row, w in enumerate(found.of(ids_of(part.column("doc_id")))) if len(w)}
    if not wanted:
        return {}
    rows = list(wanted)
    hashes, owner, before = window_hashes(part.column("text").take(pa.array(rows)), window)
    edges = np.searchsorted(owner, np.arange(len(rows) + 1))
    masks = {}
    for i, row in enumerate(rows):
        hit = np.isin(hashes[edges[i] : edges[i + 1]], wanted[row])
        change = np.zeros(int(before[i + 1] - before[i]) + 1, dtype=np.int64)
        places = np.flatnonzero(hit)
        np.add.at(change, places, 1)
        np.add.at(change, places + window, -1)
        masks[row] = np.cumsum(change[:-1]) > 0
    return masks
