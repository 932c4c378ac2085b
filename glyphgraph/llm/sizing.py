"""How many groups to deal work into, from the size of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BYTES = 16 << 20


def text_buckets(docs: DataFrame, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> int:
    """A number of hash buckets that grows with the text, so that each stays within a task's memory."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, -(-total // bucket_bytes))
