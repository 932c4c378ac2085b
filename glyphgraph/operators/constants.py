"""A small lookup table inside an expression, for arrays whose items never become rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import let

# A table of more rows than this is no constant; beyond it use a join.
MOST_CONSTANT_ROWS = 1 << 16


class ConstantTable:
    """Whole numbers by whole numbers: every key lies in one of the two slots that its hash names.

    So a lookup reads two items of an array, however many rows there are. The arrays are constants of the plan, which is
    why the number of rows is bounded.
    """

    def __init__(self, keys: list[int | None], values: list[int]):
        self._mask = len(keys) - 1
        self._keys, self._values = _constant(keys), _constant(values)

    @staticmethod
    def of(table: DataFrame, key: str, value: str, most_rows: int = MOST_CONSTANT_ROWS) -> ConstantTable | None:
        """The table of `key` and `value`, LONGs that are not NULL; None when it has too many rows."""
        rows = table.select(key, value, F.xxhash64(key)).limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            return None
        bits = max(4, (4 * len(rows)).bit_length())
        # with a quarter of the slots in use keys settle at once but for very rare cases
        while (slots := _settled([tuple(row) for row in rows], 1 << bits)) is None:
            bits += 1
        return ConstantTable([s and s[0] for s in slots], [s[1] if s else 0 for s in slots])

    def values_of(self, items: Column, missing: int = 0) -> Column:
        """The value of every item of an array, `missing` for NULL and what is no key."""

        def value(item: Column, hashed: Column) -> Column:
            one, two = (place.bitwiseAND(F.lit(self._mask)).cast("int") for place in (hashed, F.shiftright(hashed, 32)))
            return (
                F.when(F.get(self._keys, one) == item, F.get(self._values, one))
                .when(F.get(self._keys, two) == item, F.get(self._values, two))
                .otherwise(F.lit(missing).cast("long"))
            )

        return let(items, lambda array: F.zip_with(array, F.transform(array, lambda item: F.xxhash64(item)), value))


def _constant(numbers: list[int | None]) -> Column:
    return F.from_json(F.lit(json.dumps(numbers)), "array<bigint>")


def _settled(rows: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int] | None] | None:
    """The rows (key, value, hash) in slots, each in one of its two; None if they do not fit."""
    slots: list[tuple[int, int, int] | None] = [None] * size
    for row in rows:
        place = row[2] & size - 1
        for _ in range(64):
            row, slots[place] = slots[place], row
            if row is None:
                break
            # the row that was there goes to its other slot
            one, two = row[2] & size - 1, row[2] >> 32 & size - 1
            place = two if place == one else one
        else:
            return None
    return slots
