"""Readers for comments, corpus edges, vertices and id edges.

A source is a path (with `format`) or the name of a catalog table (`format="table"`). Field names are
mapped and types cast on the way in, so numbers stored as strings are accepted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas

# Text formats have no types of their own: everything is read as a string and then cast.
_UNTYPED = {"json", "csv"}


def read_table(
    spark: SparkSession,
    source: str,
    columns: Mapping[str, str],
    schema: T.StructType,
    *,
    format: str = "parquet",
    **options: str,
) -> DataFrame:
    """Read the fields `columns` (stored name -> name), cast to `schema`; other fields are not read."""
    if format == "table":
        frame = spark.table(source)
    else:
        reader = spark.read.format(format).options(**options)
        if format in _UNTYPED:
            reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        frame = reader.load(source)
    kinds = {field.name: field.dataType for field in schema}
    return frame.select(
        *[F.col(stored).cast(kinds[name]).alias(name) for stored, name in columns.items()]
    )


def read_comments(
    spark: SparkSession,
    source: str,
    *,
    id_column: str = "comment_id",
    text_column: str = "content",
    format: str = "parquet",
    **options: str,
) -> DataFrame:
    """comments(comment_id, content)"""
    columns = {id_column: "comment_id", text_column: "content"}
    return read_table(spark, source, columns, schemas.COMMENTS, format=format, **options)


def read_bigram_edges(
    spark: SparkSession, source: str, *, format: str = "parquet", **options: str
) -> DataFrame:
    """Stored corpus edges as (src, dst, weight) by name."""
    return read_table(
        spark, source, schemas.STORED_BIGRAM_EDGES, schemas.BIGRAM_EDGES, format=format, **options
    )


def read_vertices(
    spark: SparkSession, source: str, *, format: str = "parquet", **options: str
) -> DataFrame:
    """Stored vertices as (id, name)."""
    return read_table(
        spark, source, schemas.STORED_VERTICES, schemas.VERTICES, format=format, **options
    )


def read_id_edges(
    spark: SparkSession, source: str, *, format: str = "parquet", **options: str
) -> DataFrame:
    """Stored edges between ids as (src, dst, weight)."""
    return read_table(
        spark, source, schemas.STORED_ID_EDGES, schemas.ID_EDGES, format=format, **options
    )


def read_json_lines(
    spark: SparkSession, source: str, columns: Mapping[str, str], schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """Text with one JSON object per line, as (good rows, rejected lines).

    The fields `columns` (stored name -> name) are cast to `schema`; other fields, such as an export's `_id`, are
    passed over. A line that is no object, lacks a field or holds a value that cannot be cast does not stop the read: it
    comes back as (line, reason). Blank lines are neither.
    """
    kinds = {field.name: field.dataType for field in schema}
    record = T.StructType([T.StructField(field, T.StringType()) for field in columns])
    record = record.add("_broken", T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    lines = spark.read.text(source).where(F.trim("value") != "")
    parsed = lines.select(F.col("value").alias("line"), F.from_json("value", record, options).alias("record"))
    values = {name: F.col("record")[field].try_cast(kinds[name]) for field, name in columns.items()}
    reason = F.when(F.col("record").isNull() | F.col("record._broken").isNotNull(), "no JSON object")
    for field, name in columns.items():
        reason = reason.when(F.col("record")[field].isNull(), f"{field} is missing")
        reason = reason.when(values[name].isNull(), f"{field} is no {kinds[name].simpleString()}")
    judged = parsed.select("line", *[v.alias(n) for n, v in values.items()], reason.alias("reason"))
    return judged.where(F.col("reason").isNull()).select(*values), judged.where(F.col("reason").isNotNull()).select("line", "reason")


def read_bigram_json(spark: SparkSession, source: str) -> tuple[DataFrame, DataFrame]:
    """Exported corpus edges, one JSON object per line: (src, dst, weight) and the rejected lines."""
    return read_json_lines(spark, source, schemas.STORED_BIGRAM_EDGES, schemas.BIGRAM_EDGES)
