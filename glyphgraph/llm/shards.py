"""Bringing what was found about documents back to their texts.

Both sides are grouped by a shard of document ids. What was found travels packed, one row per sender and
shard, and each text is shuffled once; Spark reuses that exchange when a plan needs the texts twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import NO_ID, packed, unpacked

FOUND = "shard long, docs binary, counts binary, payload binary"


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and how long it is."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return begins, np.diff(np.append(begins, len(values)))


def _shard_column(doc_id: str, shards: int) -> Column:
    key = F.coalesce(F.col(doc_id), F.lit(int(NO_ID)))
    return F.pmod(key.bitwiseXOR(F.shiftright(key, 16)), F.lit(shards)).cast("long")


def pack_found(docs: np.ndarray, payload: np.ndarray, shards: int) -> pa.Table:
    """A row per shard from the rows of `payload` and the document that each is about."""
    shard = (docs ^ (docs >> 16)) % shards
    order = np.lexsort((docs, shard))
    rows = []
    for begin, n in zip(*runs(shard[order]), strict=True):
        part = order[begin : begin + n]
        first, counts = runs(docs[part])
        rows.append((int(shard[part[0]]), packed(docs[part][first]), packed(counts), packed(payload[part])))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["shard", "docs", "counts", "payload"]
    )


class Found:
    """What was found about the documents of a shard, to be looked up by document."""

    def __init__(self, table: pa.Table, dtype, width: int = 1):
        docs = np.repeat(unpacked(table["docs"], np.int64), unpacked(table["counts"], np.int64))
        payload = unpacked(table["payload"], dtype).reshape(-1, width)
        order = np.argsort(docs, kind="stable")
        self.docs, self.payload = docs[order], payload[order]

    def of(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        low, high = np.searchsorted(self.docs, ids), np.searchsorted(self.docs, ids, side="right")
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            yield self.payload[a:b]


def with_found(
    docs: DataFrame, found: DataFrame, shards: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str
) -> DataFrame:
    """`work` on the texts (doc_id, text) of each shard and what was found about them."""
    left = docs.select("doc_id", "text", _shard_column("doc_id", shards).alias("shard")).groupBy("shard")
    return left.cogroup(found.groupBy("shard")).applyInArrow(work, schema)
