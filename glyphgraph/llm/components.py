"""Connected components of an edge table: distributed union-find by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import Tables


def _summary(edges: DataFrame) -> tuple:
    state = F.xxhash64("high", "low").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(state)).first())


def _oriented(edges: DataFrame, a: str, b: str) -> DataFrame:
    high, low = F.greatest(a, b).alias("high"), F.least(a, b).alias("low")
    return edges.where(F.col(a) != F.col(b)).select(high, low).distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest id reachable from each end of an edge: (id, component), from edges (a, b).

    Every round hangs the larger neighbours of each node on its smallest one, then its smaller neighbours;
    both keep components together and shorten every path, so rounds grow with the logarithm of the longest.
    A node's rows are joined, never gathered. Each round is written, which bounds the plan, and what it was made
    from is deleted then; the last round's table stays for the result.
    """
    with Tables(edges.sparkSession) as tables:
        current = tables.write(_oriented(edges, "a", "b"), "links")
        before = None
        while (now := _summary(current)) != before:
            before = now
            both = current.select(F.col("high").alias("node"), F.col("low").alias("near")).unionByName(
                current.select(F.col("low").alias("node"), F.col("high").alias("near"))
            )
            least = both.groupBy("node").agg(F.least("node", F.min("near")).alias("root"))
            large = both.where(F.col("near") > F.col("node")).join(least.hint("merge"), "node")
            current = _oriented(large.select("near", "root"), "near", "root")
            roots = current.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root"))
            small = current.join(roots.hint("merge"), F.col("high") == F.col("node")).select("low", "root")
            small = small.unionByName(roots.select(F.col("node").alias("low"), "root"))
            current = tables.write(_oriented(small, "low", "root"), "links")
        tables.keep("links")
    ends = current.select(F.col("high").alias("id"), F.col("low").alias("component"))
    roots = current.select(F.col("low").alias("id"), F.col("low").alias("component")).distinct()
    return ends.unionByName(roots)
