"""A graph saved as two catalog tables, with a manifest that reading checks them against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import Graph
from . import schemas
from .readers import read_id_edges, read_vertices

_MANIFEST = "part string, fields string, n_rows long, checksum decimal(38,0)"


def _checksum(columns: list[str]) -> Column:
    """A sum over the rows, so neither their order nor how they are split into files matters."""
    return F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)")


def _fields(frame: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in frame.dtypes)


def save_graph(graph: Graph, name: str, *, location: str | None = None) -> None:
    """Save vertices(id, name) and edges(src, dst, weight) as the tables `name`_vertices and `name`_edges.

    `location` is a folder for their files; without it they lie in the warehouse. What a table had is replaced. The
    manifest goes first and comes back last, so a save that was cut short cannot be read. Rows are counted and
    summed up while they are written.
    """
    spark = graph.edges.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}_manifest")
    lines = []
    for part, columns in _PARTS.items():
        frame = getattr(graph, part)
        stored = frame.select(*[F.col(inner).alias(field) for field, inner in columns.items()])
        seen = Observation()
        sums = [F.count("*").alias("n_rows"), _checksum(stored.columns).alias("checksum")]
        _save_as(stored.observe(seen, *sums), f"{name}_{part}", location)
        lines.append((part, _fields(stored), seen.get["n_rows"], seen.get["checksum"]))
    _save_as(spark.createDataFrame(lines, _MANIFEST).coalesce(1), f"{name}_manifest", location)


_PARTS = {"vertices": schemas.STORED_VERTICES, "edges": schemas.STORED_ID_EDGES}


def _save_as(frame: DataFrame, table: str, location: str | None) -> None:
    writer = frame.write.mode("overwrite").format("parquet")
    if location is not None:
        writer = writer.option("path", f"{location}/{table.rpartition('.')[2]}")
    writer.saveAsTable(table)


def read_graph(spark: SparkSession, name: str, *, verify: bool = True) -> Graph:
    """The graph that `save_graph` saved under `name`.

    It is an error when there is no manifest, or a table differs from it in its fields, the number of its rows or
    their checksum. With `verify=False` only the fields are compared, which reads no rows.
    """
    if not spark.catalog.tableExists(f"{name}_manifest"):
        raise ValueError(f"{name} was not saved whole: it has no manifest")
    manifest = {row["part"]: row for row in spark.table(f"{name}_manifest").collect()}
    for part in _PARTS:
        stored, line = spark.table(f"{name}_{part}"), manifest[part]
        if _fields(stored) != line["fields"]:
            raise ValueError(f"{name}_{part} has the fields {_fields(stored)}, the manifest {line['fields']}")
        if verify:
            found = tuple(stored.agg(F.count("*"), _checksum(stored.columns)).first())
            if found != (line["n_rows"], line["checksum"]):
                raise ValueError(f"{name}_{part} does not hold the rows that were saved")
    return Graph(
        read_vertices(spark, f"{name}_vertices", format="table"), read_id_edges(spark, f"{name}_edges", format="table")
    )
