"""Column functions on single characters. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that never take part in a corpus pair.
EXCLUDED_CHARACTERS = [
    "。", "，", "！", "？", "：", "；", "～", "（", "）", " ", "~", "?", ";", ".", "&",
    "\0", "'", "(", ")", "[", "]", ",", "\\", "$", "@", "/",
    "0", "1", "2", "3", "4", "5", "6", "7", "8", "9",
]

# A code point fits 21 bits, so two of them fit one LONG without collision.
CODE_POINT_RANGE = 1 << 21

# Fixed value: distance between the numeric ids of two comments' first characters.
VERTEX_NUMBER_STEP = 10000


def is_kept(ch: Column) -> Column:
    """True for a character that may be part of a corpus pair."""
    return ~ch.isin(EXCLUDED_CHARACTERS)


def pair_key(first: Column, second: Column) -> Column:
    """Both code points of a pair of single characters in one LONG.

    A LONG key makes Spark use its primitive hash relation, which is about twice as fast here as
    hashing two strings. NULL when either side is NULL.
    """
    return F.ascii(first).cast("long") * F.lit(CODE_POINT_RANGE) + F.ascii(second)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, wherever body uses it."""
    return F.transform(F.array(value), body)[0]


def pair_keys(before: Column, chars: Column, after: Column) -> Column:
    """The pair key of every two neighbours in (before, *chars, after); NULL where a side is."""

    def keys(codes: Column) -> Column:
        left = F.concat(F.array(F.ascii(before).cast("long")), codes)
        right = F.concat(codes, F.array(F.ascii(after).cast("long")))
        return F.zip_with(left, right, lambda a, b: a * F.lit(CODE_POINT_RANGE) + b)

    return let(F.transform(chars, lambda ch: F.ascii(ch).cast("long")), keys)


def char_code(name: Column) -> Column:
    """Little-endian integer of the UTF-8 bytes; 0 for the empty string, an error above 8 bytes."""
    digits = F.hex(F.encode(name, "UTF-8"))
    reversed_digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(7, -1, -1)])
    # base -10 reads the 64 bits as a signed number
    code = F.coalesce(F.conv(reversed_digits, 16, -10).cast("long"), F.lit(0).cast("long"))
    return (
        F.when(name.isNull(), F.lit(None).cast("long"))
        .when(
            F.octet_length(name) > 8,
            F.raise_error(F.concat(F.lit("more than 8 UTF-8 bytes: "), name)).cast("long"),
        )
        .otherwise(code)
    )


def vertex_number(comment_id: Column, pos: Column) -> Column:
    """Numeric id of a comment's character. For display only: texts over 10,000 characters overlap."""
    return comment_id * F.lit(VERTEX_NUMBER_STEP) + pos
