"""The comments: slices of the table and the path of characters that every comment forms."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pair_key, pair_keys
from ..operators import (
    BROADCAST_BYTES,
    Graph,
    all_characters,
    deep_slice,
    lookup_join,
    materialize_sized,
    running_totals,
    text_units,
    unit_characters,
)
from ..operators.characters import spread
from ..operators.constants import MOST_CONSTANT_ROWS
from .expanding import linking
from .gluing import PairWeights


# A slice that skips more rows than this is located by counts.
DEEP = 100_000


def comment_slice(
    comments: DataFrame, *, after_id: int = 1, skip: int = 320, limit: int = 50, deep: int = DEEP
) -> DataFrame:
    """The comments with an id above `after_id`, ordered by id: skip some, then take some.

    The condition reaches the scan, and every task keeps only its first skip + limit rows. Beyond `deep` skipped
    rows the slice is located by counting ids, and no task keeps any of the skipped ones.
    """
    wanted = comments.where(F.col("comment_id") > after_id)
    if skip > deep:
        return deep_slice(wanted, "comment_id", skip, limit)
    return wanted.orderBy("comment_id").offset(skip).limit(limit)


def char_positions(comments: DataFrame, *, dealt: bool = False) -> DataFrame:
    """Every character of every comment, punctuation included: (comment_id, pos, ch)."""
    return all_characters(comments, dealt=dealt).select("comment_id", "pos", "ch")


def numbered_vertices(comments: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every character as a vertex with a number of its own: (id, comment_id, pos, name).

    A comment's characters are numbered from the sum of the lengths of all comments with a smaller id, so numbers
    neither collide nor leave gaps, however long texts are. Only ids and lengths are ordered; no character is.
    Comment ids must be unique; NULL texts have no vertices.
    """
    # an empty text is one empty character
    length = F.greatest(F.char_length("content"), F.lit(1)).cast("long").alias("length")
    lengths = comments.where(F.col("content").isNotNull()).select("comment_id", length)
    starts, size = materialize_sized(running_totals(lengths, "comment_id", "length", "first").drop("length"), "first-numbers")
    placed = lookup_join(spread(comments), starts, "comment_id", small=size <= broadcast_bytes)
    units = text_units(placed.select(F.struct("comment_id", "first").alias("comment_id"), "content"))
    characters = unit_characters(units, "comment_id").select("comment_id.comment_id", "comment_id.first", "pos", "ch")
    return characters.select((F.col("first") + F.col("pos")).alias("id"), "comment_id", "pos", F.col("ch").alias("name"))


def blank_edges(comments: DataFrame, *, dealt: bool = False) -> DataFrame:
    """The path edges with weight 0: (comment_id, pos, src_name, dst_name, weight)."""
    return (
        all_characters(comments, dealt=dealt)
        .where(F.col("next").isNotNull())
        .select(
            "comment_id",
            "pos",
            F.col("ch").alias("src_name"),
            F.col("next").alias("dst_name"),
            F.lit(0).cast("long").alias("weight"),
        )
    )


def pair_weights(corpus: DataFrame) -> DataFrame:
    """Corpus weight by pair key, one row per pair: (pair, pair_weight).

    Pairs stored twice are added up. Only single characters can be part of a comment's path.
    """
    single = (F.char_length("src") == 1) & (F.char_length("dst") == 1)
    return (
        corpus.where(single)
        .groupBy(pair_key(F.col("src"), F.col("dst")).alias("pair"))
        .agg(F.sum("weight").alias("pair_weight"))
    )


def written_weights(corpus: DataFrame, broadcast_bytes: int) -> tuple[DataFrame, bool]:
    """The pair weights as a written table, and whether it may be broadcast."""
    weights, size = materialize_sized(pair_weights(corpus), "pair-weights")
    return weights, size <= broadcast_bytes


def pair_table(weights: DataFrame) -> PairWeights | None:
    """The weights for the tasks; None if there are too many, or some too large to be multiplied by ten."""
    rows = weights.limit(MOST_CONSTANT_ROWS + 1).toArrow()
    keys, values = (pc.fill_null(rows.column(c), 0).to_numpy() for c in ("pair", "pair_weight"))
    if len(keys) > MOST_CONSTANT_ROWS or (len(values) and np.abs(values).max() >= 1 << 58):
        return None
    return PairWeights(keys, values)


def join_weight(
    rows: DataFrame, weights: DataFrame, first: str, second: str, name: str, small: bool
) -> DataFrame:
    """Add the corpus weight of the pair (first, second) as `name`, 0 for a pair not in the corpus."""
    keyed = rows.withColumn("pair", pair_key(F.col(first), F.col(second)))
    joined = lookup_join(keyed, weights, "pair", small=small)
    return joined.select(
        *rows.columns, F.coalesce("pair_weight", F.lit(0).cast("long")).alias(name)
    )


# Stretches whose pairs are looked up together. Shorter ones have fewer different pairs, which a character's
# lookup passes over one by one; longer ones share more of them.
DICTIONARY_CHARACTERS = 1 << 12

# Text of a shuffle partition, before it is expanded, and how much larger texts are than what is stored of them.
PARTITION_BYTES = 64 << 20
STORED_TIMES = 3


def text_partitions(comments: DataFrame) -> int:
    """Shuffle partitions for texts that are going to be expanded: by their bytes, never fewer than the cores.

    The number is given explicitly, since the small size of the texts would have them merged into a few. It rests
    on Spark's own estimate, so nothing is read for it.
    """
    spark = comments.sparkSession
    size = int(str(comments._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = STORED_TIMES * size if size < 1 << 60 else 0
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        2 * spark.sparkContext.defaultParallelism,
        size // PARTITION_BYTES + 1,
    )


def dealt_units(comments: DataFrame, unit_size: int) -> DataFrame:
    """The stretches of all texts, dealt out by `key`: (key, comment_id, unit, before, body, after).

    Texts are shuffled here and not again before they are put together; a NULL text gives one stretch without body.
    """
    units = text_units(comments.select("comment_id", "content"), unit_size, keep_null=True)
    # as one column that every use needs whole, so that the same rows serve all uses of a plan
    around = F.array("before", "body", "after").alias("around")
    dealt = units.select(F.struct("comment_id", "unit").alias("key"), around).repartition(text_partitions(comments), "key")
    parts = [F.col("around")[i].alias(name) for i, name in enumerate(("before", "body", "after"))]
    return dealt.select("key", "key.comment_id", "key.unit", *parts)


# A stretch's dictionary has so many parts, by the lowest bits of a pair, as a part is searched from its front.
_PARTS = 16


def _part_of(entries: str, part: int) -> Column:
    """The entries of one part of a dictionary, as a map."""
    low = F.lit(_PARTS - 1).cast("long")
    return F.map_from_entries(F.filter(entries, lambda e: e["pair"].bitwiseAND(low) == part))


def weighted_units(
    comments: DataFrame, weights: DataFrame, small: bool, *, unit_size: int = DICTIONARY_CHARACTERS
) -> DataFrame:
    """Stretches of all texts with the corpus weights of their pairs: (comment_id, unit, before, body, after, weights).

    `weights` has one more item than the stretch has characters: the weight of the pair that ends at its first
    character, of each pair within, and of the pair that begins at its last one. The *different* pairs of a
    stretch are looked up, each once, and put into the array by a dictionary; so the lookup sees few rows per text, not
    its characters. Texts are shuffled once, and their dictionaries follow them. A NULL text gives one stretch
    without body.
    """
    units = dealt_units(comments, unit_size)
    pairs = pair_keys(F.col("before"), F.split("body", ""), F.col("after"))
    # in the order they occur first, which has frequent ones early
    different = units.select("key", F.posexplode(F.array_distinct(pairs)).alias("rank", "pair"))
    found = lookup_join(different.where(F.col("pair").isNotNull()), weights, "pair", small=small)
    entry = F.struct("rank", "pair", F.coalesce("pair_weight", F.lit(0).cast("long")).alias("weight"))
    entries = F.transform(F.sort_array(F.collect_list(entry)), lambda e: F.struct(e["pair"], e["weight"]))
    entries = found.groupBy("key").agg(F.array_distinct(entries).alias("entries"))
    known = entries.select("key", F.array(*[_part_of("entries", k) for k in range(_PARTS)]).alias("known"))

    def weight_of(pair: Column) -> Column:
        part = F.get("known", pair.bitwiseAND(F.lit(_PARTS - 1)).cast("int"))
        return F.coalesce(part[pair], F.lit(0).cast("long"))

    weight = F.transform(pairs, weight_of)
    return units.join(known.hint("merge"), "key", "left").select(
        "comment_id", "unit", "before", "body", "after", weight.alias("weights")
    )


def weighted_characters(
    comments: DataFrame, weights: DataFrame, small: bool, *, unit_size: int = DICTIONARY_CHARACTERS
) -> DataFrame:
    """Every character with the weights on either side: (comment_id, pos, ch, next, w_in, w_out)."""
    units = weighted_units(comments.where(F.col("content").isNotNull()), weights, small, unit_size=unit_size)
    chars = F.split("body", "")
    n = F.size("weights") - 1
    row = F.arrays_zip(
        chars.alias("ch"),
        F.concat(F.slice(chars, 2, n), F.array("after")).alias("next"),
        F.slice("weights", 1, n).alias("w_in"),
        F.slice("weights", 2, n).alias("w_out"),
    )
    pos = F.col("unit").cast("long") * unit_size + F.col("place")
    return units.select("comment_id", "unit", F.posexplode(row).alias("place", "row")).select(
        "comment_id", pos.alias("pos"), "row.ch", "row.next", "row.w_in", "row.w_out"
    )


def weighted_edges(
    comments: DataFrame,
    corpus: DataFrame,
    *,
    broadcast_bytes: int = BROADCAST_BYTES,
    dealt: bool = False,
    in_tasks: bool = False,
) -> DataFrame:
    """The path edges with their corpus weight: (comment_id, pos, src_name, dst_name, weight).

    With `in_tasks` the weights of a corpus of few pairs go to the tasks, which expand whole stretches (Arrow).
    """
    weights, small = written_weights(corpus, broadcast_bytes)
    if in_tasks and small and (pairs := pair_table(weights)):
        units = text_units((comments if dealt else spread(comments)).select("comment_id", "content"))
        kind = units.schema["comment_id"].dataType.simpleString()
        return units.mapInArrow(
            linking(pairs), f"comment_id {kind}, pos long, src_name string, dst_name string, weight long"
        )
    if small:
        blank = blank_edges(comments, dealt=dealt).drop("weight")
        return join_weight(blank, weights, "src_name", "dst_name", "weight", small)
    edges = weighted_characters(comments, weights, small).where(F.col("next").isNotNull())
    return edges.select(
        "comment_id", "pos", F.col("ch").alias("src_name"), F.col("next").alias("dst_name"), F.col("w_out").alias("weight")
    )


def path_starts(comments: DataFrame) -> DataFrame:
    """The characters without in-edge: (comment_id, pos)."""
    return all_characters(comments).where(F.col("prev").isNull()).select("comment_id", "pos")


def path_ends(comments: DataFrame) -> DataFrame:
    """The characters without out-edge: (comment_id, pos)."""
    return all_characters(comments).where(F.col("next").isNull()).select("comment_id", "pos")


def comment_graph(
    comments: DataFrame, corpus: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES
) -> Graph:
    """All comments as one graph: vertices(id, name), edges(src, dst, weight).

    An id is the struct (comment_id, pos), so texts of any length keep apart. The characters of a text lie together,
    as vertices and as edges, since texts are dealt out by their ids before they are expanded.
    """
    comments = comments.select("comment_id", "content").repartition(text_partitions(comments), "comment_id")

    def at(pos):
        return F.struct(F.col("comment_id"), pos.alias("pos"))

    pos = F.col("pos")
    vertices = char_positions(comments, dealt=True).select(at(pos).alias("id"), F.col("ch").alias("name"))
    edges = weighted_edges(comments, corpus, broadcast_bytes=broadcast_bytes, dealt=True).select(
        at(pos).alias("src"), at(pos + 1).alias("dst"), "weight"
    )
    return Graph(vertices, edges)
