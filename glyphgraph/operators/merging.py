"""Putting very many pieces of one key together in order, without gathering them in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ids import positions

# Pieces put together at a time, as a power of two, and how often before the rest is.
FAN_BITS, LEVELS = 10, 2


def merge_in_order(
    rows: DataFrame,
    keys: list[str],
    place: str,
    combine: Callable[[Column], dict[str, Column]],
    *,
    fan_bits: int = FAN_BITS,
    levels: int = LEVELS,
) -> DataFrame:
    """(*keys, ...columns): the pieces of each key combined in the order of `place`, a LONG that differs among them.

    `combine` takes an array of the pieces' structs in order and gives the columns of the whole; it has to be
    associative. Pieces whose places share all but their last ten bits are combined first, then those that share all
    but their last twenty: a task gathers at most 1,024 pieces of a key at a time. What is left of a key is one
    piece for every million, and these are combined at last. With `levels` 0 all pieces of a key are combined at once,
    for keys that are known to have few.
    """
    columns = [c for c in rows.columns if c not in (*keys, place)]
    for level in range(levels + 1):
        last = level == levels
        block = [] if last else [F.shiftright(F.col(place), fan_bits).alias(place)]
        pieces = F.sort_array(F.collect_list(F.struct(place, *columns))).alias("pieces")
        grouped = rows.groupBy(*keys, *block).agg(pieces)
        made = [value.alias(name) for name, value in combine(F.col("pieces")).items()]
        rows = grouped.select(*keys, *([] if last else [place]), *made)
    return rows


def concat_sorted(rows: DataFrame, key: str, value: str, separator: str, *, fan_bits: int = FAN_BITS) -> DataFrame:
    """(key, value): the strings of each key in order, joined; a key may have any number of them.

    The rows are sorted over range partitions, which cut a key with very many of them, and numbered; stretches
    of a key are joined where they lie next to one another, and then the stretches.
    """
    placed = positions(rows.select(key, value), key, value, name="place")
    return merge_in_order(placed, [key], "place", lambda pieces: {value: F.array_join(pieces[value], separator)}, fan_bits=fan_bits)
