"""Named sources in the Spark catalog, with settings that a load may override."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import schemas
from .readers import read_table

# The table property that keeps which stored field stands for which column.
_COLUMNS = "glyphgraph.columns"


class SourceRegistry:
    """Sources by name: each is a catalog table of one database, with the names of its fields.

    A load takes the settings that a source was registered with, and any of them can be given anew for that load alone:
    another database, another table, other fields.
    """

    def __init__(self, spark: SparkSession, database: str = "default"):
        self._spark, self.database = spark, database

    def _name(self, table: str, database: str | None = None) -> str:
        return f"`{database or self.database}`.`{table}`"

    def add(self, table: str, path: str, columns: Mapping[str, str], *, format: str = "parquet", **options: str) -> None:
        """Register the files at `path`; `columns` maps stored fields to column names. Replaces what had the name."""
        name = self._name(table)
        self._spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._spark.catalog.createTable(name, path=path, source=format, **options)
        value = json.dumps(dict(columns)).replace("'", "\\'")
        self._spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{_COLUMNS}' = '{value}')")

    def columns(self, table: str, *, database: str | None = None) -> dict[str, str]:
        """The stored fields and their columns that a source was registered with."""
        shown = self._spark.sql(f"SHOW TBLPROPERTIES {self._name(table, database)}").collect()
        found = [row["value"] for row in shown if row["key"] == _COLUMNS]
        return json.loads(found[0]) if found else {}

    def load(
        self,
        table: str,
        schema: T.StructType = schemas.COMMENTS,
        *,
        database: str | None = None,
        columns: Mapping[str, str] | None = None,
    ) -> DataFrame:
        """The source as `schema`. `columns` overrides the stored fields of some columns, `database` where to look."""
        stored = {name: field for field, name in self.columns(table, database=database).items()}
        stored |= {name: field for field, name in (columns or {}).items()}
        missing = [field.name for field in schema if field.name not in stored]
        if missing:
            raise ValueError(f"no stored field is known for {', '.join(missing)}")
        wanted = {stored[field.name]: field.name for field in schema}
        return read_table(self._spark, self._name(table, database), wanted, schema, format="table")
