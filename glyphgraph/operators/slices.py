"""A slice of an ordered table, however deep it lies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ids import positions


def deep_slice(frame: DataFrame, column: str, skip: int, limit: int) -> DataFrame:
    """The rows number skip to skip + limit - 1 in the order of `column`, a LONG; NULL comes first, ties in any order.

    Only the column is ordered: its range partitions are counted, which tells where the skipped rows end, and no
    task keeps what is skipped. The bounds of the slice, two numbers, then go to the scan of the whole rows. The rows
    that meet them are the slice and others that tie with its ends.
    """
    placed = positions(frame.select(column), column, name="place")
    wanted = placed.where((F.col("place") >= skip) & (F.col("place") < skip + limit))
    bounds = wanted.agg(F.min(column), F.max(column), F.count("*"), F.count(column)).first()
    low, high, rows, filled = bounds
    key = F.col(column)
    inside = F.lit(False) if not rows else key.isNull() if not filled else key.between(low, high)
    if rows and filled and filled < rows:
        inside = inside | key.isNull()
    # at most `limit` rows: how many of each value belong to the slice
    share = wanted.groupBy(F.col(column).alias("slice_key")).agg(F.count("*").alias("slice_share"))
    near = frame.where(inside).withColumn("slice_rank", F.row_number().over(Window.partitionBy(column).orderBy(column)))
    taken = near.join(F.broadcast(share), key.eqNullSafe(F.col("slice_key")))
    return taken.where(F.col("slice_rank") <= F.col("slice_share")).select(*frame.columns).orderBy(column)
