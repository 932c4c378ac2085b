"""Left join against a table with at most one row per key, safe for big tables and hot keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialize

# A lookup table is broadcast only when its estimated size in memory is at most this.
BROADCAST_BYTES = 256 << 20

_ROW_OVERHEAD = 64  # hash relation entry: key, pointers and row header
_FIXED_FIELD = 16


def row_bytes(kind: T.DataType, column: Column) -> Column:
    """Bytes that one value takes in a row."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + F.lit(_FIXED_FIELD)
    if isinstance(kind, T.StructType):
        parts = [row_bytes(field.dataType, column[field.name]) for field in kind]
        return sum(parts, F.lit(_FIXED_FIELD))
    if isinstance(kind, T.ArrayType | T.MapType):
        raise TypeError(f"cannot bound the size of a {kind.simpleString()} column")
    return F.lit(_FIXED_FIELD)


def size_of_rows(frame: DataFrame) -> Column:
    """Aggregate: the size of a table as a broadcast relation, from row count and string lengths."""
    size = sum((row_bytes(f.dataType, F.col(f.name)) for f in frame.schema), F.lit(_ROW_OVERHEAD))
    return F.coalesce(F.sum(size), F.lit(0))


def estimated_bytes(frame: DataFrame) -> int:
    """The same as a number; one pass over the table."""
    return frame.agg(size_of_rows(frame)).first()[0]


def observed_size(frame: DataFrame, write: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """Write a table by `write` and learn its size in the same pass."""
    seen = Observation()
    written = write(frame.observe(seen, size_of_rows(frame).alias("bytes")))
    return written, seen.get["bytes"]


def materialize_sized(frame: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The same for a table in the shared folder that stays there."""
    return observed_size(frame, lambda sized: materialize(sized, name))


def fits_broadcast(frame: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table may be broadcast. Costs one pass over it, so give it a written table."""
    return estimated_bytes(frame) <= broadcast_bytes


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    broadcast_bytes: int = BROADCAST_BYTES,
    small: bool | None = None,
) -> DataFrame:
    """`left` with the columns of `right` for its `key`, NULL where `right` has no such key.

    `right` must hold a key at most once. When its size is within `broadcast_bytes` it is broadcast and
    `left` is not shuffled. Beyond that it is one merge join, so `left` is computed once; where a key is
    hot, adaptive execution cuts that partition of `left` into pieces. Pass `small` when the size has been
    checked already.
    """
    if small is None:
        small = fits_broadcast(right, broadcast_bytes)
    if small:
        return left.join(F.broadcast(right), key, "left")
    # named, because Spark may take an expanded table for small and broadcast it
    return left.join(right.hint("merge"), key, "left")
