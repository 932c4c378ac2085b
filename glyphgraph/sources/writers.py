"""Writers. Everything is written by the executors; nothing passes through the driver.

A second run replaces the table (`mode="overwrite"`); `mode="append"` adds to it instead.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schemas


def save_table(
    frame: DataFrame,
    target: str,
    columns: Mapping[str, str],
    *,
    format: str = "parquet",
    mode: str = "overwrite",
) -> None:
    """Write the columns `columns` (stored name -> name) to a path, or a catalog table for "table"."""
    stored = frame.select(*[F.col(name).alias(field) for field, name in columns.items()])
    writer = stored.write.mode(mode)
    if format == "table":
        writer.saveAsTable(target)
    else:
        writer.format(format).save(target)


def save_bigram_edges(edges: DataFrame, target: str, **how: str) -> None:
    """edges(src, dst, weight) by name, stored as sourceName, desName, weight."""
    save_table(edges, target, schemas.STORED_BIGRAM_EDGES, **how)


def save_vertices(vertices: DataFrame, target: str, **how: str) -> None:
    """vertices(id, name), stored as vertexId, wordName."""
    save_table(vertices, target, schemas.STORED_VERTICES, **how)


def save_id_edges(edges: DataFrame, target: str, **how: str) -> None:
    """edges(src, dst, weight) by id, stored as sourceId, desId, weight."""
    save_table(edges, target, schemas.STORED_ID_EDGES, **how)


def save_result_text(blocks: DataFrame, target: str, *, mode: str = "overwrite") -> None:
    """Text files from the single column `value`; the lines of one comment stay together."""
    blocks.select("value").write.mode(mode).text(target)
