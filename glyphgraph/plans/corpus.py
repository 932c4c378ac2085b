"""The corpus: counted character pairs of all comments, as a table and as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import char_code, is_kept
from ..operators import BROADCAST_BYTES, Graph, adjacent_pairs, all_characters, dense_ids, text_units
from ..operators.characters import spread
from ..operators.lookup import fits_broadcast, lookup_join
from .expanding import count_pairs


def kept_pairs(comments: DataFrame) -> DataFrame:
    """Adjacent pairs of which neither side is excluded: (comment_id, pos, src, dst)."""
    return adjacent_pairs(comments).where(is_kept(F.col("src")) & is_kept(F.col("dst")))


def bigram_edges(comments: DataFrame) -> DataFrame:
    """How often each kept pair occurs: (src, dst, weight). Counted on the map side before the shuffle."""
    return kept_pairs(comments).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def counted_pairs(comments: DataFrame) -> DataFrame:
    """The same edges as `bigram_edges` gives, counted in the tasks on arrays of code points (Arrow)."""
    units = text_units(spread(comments.select("comment_id", "content"))).select("body", "after")
    counted = units.mapInArrow(count_pairs, "src string, dst string, n long")
    # a count is never NULL
    return counted.groupBy("src", "dst").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("weight"))


def heaviest_first(edges: DataFrame) -> DataFrame:
    """All edges by weight; ties by name."""
    return edges.orderBy(F.desc("weight"), "src", "dst")


def top_edges(edges: DataFrame, k: int = 300) -> DataFrame:
    """The k heaviest edges; every task keeps only its own k."""
    return heaviest_first(edges).limit(k)


def names_of(edges: DataFrame) -> DataFrame:
    """Distinct names on either end of the edges, in one pass: (name)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()


def characters_with_codes(comments: DataFrame) -> DataFrame:
    """The distinct characters of all texts: (ch, code)."""
    distinct = all_characters(comments).select("ch").distinct()
    return distinct.select("ch", char_code(F.col("ch")).alias("code"))


def corpus_graph(edges: DataFrame) -> Graph:
    """The corpus with character codes as ids: vertices(id, name), edges(src, dst, weight)."""
    vertices = names_of(edges).select(char_code(F.col("name")).alias("id"), "name")
    coded = edges.select(
        char_code(F.col("src")).alias("src"), char_code(F.col("dst")).alias("dst"), "weight"
    )
    return Graph(vertices, coded)


def vertex_ids(edges: DataFrame) -> DataFrame:
    """Names numbered by rank: (id, name)."""
    return dense_ids(names_of(edges), "name")


def edges_with_ids(
    edges: DataFrame,
    vertices: DataFrame,
    *,
    missing_id: int | None = 0,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Edges with names replaced by the ids of `vertices`(id, name): (src, dst, weight).

    A name that has no vertex gets `missing_id`; None keeps it NULL.
    """
    small = fits_broadcast(vertices, broadcast_bytes)
    rows = edges
    for end in ("src", "dst"):
        ids = vertices.select(F.col("name").alias(end), F.col("id").alias(f"{end}_id"))
        rows = lookup_join(rows, ids, end, small=small)
    missing = F.lit(missing_id).cast("long")
    return rows.select(
        F.coalesce("src_id", missing).alias("src"), F.coalesce("dst_id", missing).alias("dst"), "weight"
    )
