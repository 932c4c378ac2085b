"""Positions and running totals of whole tables without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

_ROW_BITS = 33  # monotonically_increasing_id() keeps the row number of its partition in these bits


def _ranged(frame: DataFrame, *columns: str) -> DataFrame:
    """The rows in range partitions that are sorted: (..., part, place).

    Written first, because range bounds are sampled anew on every evaluation.
    """
    row_mask = (1 << _ROW_BITS) - 1
    return materialize(
        frame.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .select(
            "*",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(row_mask)).alias("place"),
        ),
        "ranked",
    )


def _with_starts(ranked: DataFrame, total) -> DataFrame:
    """With the sum of `total`, an aggregate, over the partitions before a row's own as `start`."""
    # one row per partition, so the window without a partition key is as small as the task list
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranked.groupBy("part")
        .agg(total.alias("n"))
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    )
    return ranked.join(F.broadcast(starts), "part")


def positions(frame: DataFrame, *columns: str, name: str = "position") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order of `columns`; rows that tie in all of them, in any order.

    Range partitions are sorted in parallel; each then adds the sizes of the partitions before it.
    """
    numbered = _with_starts(_ranged(frame, *columns), F.count("*"))
    return numbered.select((F.col("start") + F.col("place")).alias(name), *frame.columns)


def dense_ids(frame: DataFrame, column: str, id_column: str = "id") -> DataFrame:
    """Number the rows 0, 1, 2, ... by the rank of `column`, whose values must be distinct."""
    return positions(frame, column, name=id_column)


def running_totals(frame: DataFrame, order: str, value: str, name: str = "before") -> DataFrame:
    """With the sum of `value` over all rows before a row in the order of `order`, whose values must be distinct.

    Sums run within range partitions, side by side; each adds the sums of the partitions before it.
    """
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    summed = _with_starts(_ranged(frame, order), F.sum(value))
    earlier = F.coalesce(F.sum(value).over(within), F.lit(0))
    return summed.select(*frame.columns, (F.col("start") + earlier).cast("long").alias(name))
