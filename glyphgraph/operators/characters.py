"""From comments(comment_id, content) to one row per character or pair of adjacent characters.

Nothing here shuffles the characters: a row is expanded where it was read, and its neighbours come
from the same array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Texts are expanded in stretches of this many characters, which bounds the array held per row.
UNIT_CHARACTERS = 1 << 16

# Spark's usual size of a file split.
SPLIT_BYTES = 128 << 20


def spread(comments: DataFrame) -> DataFrame:
    """Deal the texts out to all cores when the table is too small to have a split for each of them.

    Characters take far more time than the text they come from, so a small table in one file would
    otherwise keep one core busy. Any table of more than a split per core is left alone: no shuffle.
    """
    cores = comments.sparkSession.sparkContext.defaultParallelism
    # Spark's own estimate; unlike asking for the number of partitions it never runs anything
    estimate = comments._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(estimate)) > cores * SPLIT_BYTES:
        return comments
    return comments.repartition(2 * cores, "comment_id")


def text_units(
    comments: DataFrame, unit_characters: int = UNIT_CHARACTERS, *, keep_null: bool = False
) -> DataFrame:
    """Cut every text into stretches: (comment_id, unit, before, body, after).

    `before` and `after` are the characters next to the stretch, NULL at either end of the text. A NULL
    text gives no row, or with `keep_null` one without body; an empty text gives one with an empty body.
    """
    content = F.col("content")
    # split once; a regular expression for stretches would recurse where characters change in width
    long = F.when(F.char_length(content) > unit_characters, F.split(content, ""))
    chars, last = F.col("chars"), F.size("chars") - 1
    stretches = F.when(chars.isNull(), F.array(content)).otherwise(
        F.transform(
            F.sequence(F.lit(0), last, F.lit(unit_characters)),
            lambda start: F.array_join(F.slice(chars, start + 1, unit_characters), ""),
        )
    )
    unit = F.col("unit")
    return (
        (comments if keep_null else comments.where(content.isNotNull()))
        .select("comment_id", "content", long.alias("chars"))
        .select("comment_id", stretches.alias("units"))
        # the outer form keeps Spark from evaluating the cutting a second time in a derived filter
        .select("comment_id", "units", F.posexplode_outer("units").alias("unit", "body"))
        .select(
            "comment_id",
            unit,
            F.right(F.get("units", unit - 1), F.lit(1)).alias("before"),
            "body",
            F.left(F.get("units", unit + 1), F.lit(1)).alias("after"),
        )
    )


def unit_characters(
    units: DataFrame, *keep: str, unit_characters: int = UNIT_CHARACTERS
) -> DataFrame:
    """Every character of the stretches: (*keep, pos, prev, ch, next), `pos` counted in the whole text."""
    place = F.col("place")
    return (
        units.select(*keep, "unit", "before", "after", F.split("body", "").alias("chars"))
        .select(
            *keep, "unit", "before", "after", "chars", F.posexplode_outer("chars").alias("place", "ch")
        )
        .select(
            *keep,
            (F.col("unit").cast("long") * unit_characters + place).alias("pos"),
            F.coalesce(F.get("chars", place - 1), "before").alias("prev"),
            "ch",
            F.coalesce(F.get("chars", place + 1), "after").alias("next"),
        )
    )


def all_characters(comments: DataFrame, *, dealt: bool = False) -> DataFrame:
    """Every character with its neighbours: (comment_id, pos, prev, ch, next).

    Texts that are `dealt` out already are expanded where they lie.
    """
    return unit_characters(text_units(comments if dealt else spread(comments)), "comment_id")


def adjacent_pairs(comments: DataFrame) -> DataFrame:
    """Every pair of adjacent characters: (comment_id, pos, src, dst)."""
    return (
        all_characters(comments)
        .where(F.col("next").isNotNull())
        .select("comment_id", "pos", F.col("ch").alias("src"), F.col("next").alias("dst"))
    )
