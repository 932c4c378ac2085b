"""Explicit schemas of every table that is read or written."""

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LONG = T.LongType()
_STRING = T.StringType()

COMMENTS = _schema(comment_id=_LONG, content=_STRING)

# Names inside the package ...
BIGRAM_EDGES = _schema(src=_STRING, dst=_STRING, weight=_LONG)
VERTICES = _schema(id=_LONG, name=_STRING)
ID_EDGES = _schema(src=_LONG, dst=_LONG, weight=_LONG)

# ... and the field names of the stored tables (fixed values).
STORED_BIGRAM_EDGES = {"sourceName": "src", "desName": "dst", "weight": "weight"}
STORED_VERTICES = {"vertexId": "id", "wordName": "name"}
STORED_ID_EDGES = {"sourceId": "src", "desId": "dst", "weight": "weight"}
