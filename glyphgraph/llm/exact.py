"""Exact deduplication by an extendible-hash index on shared files.

The index keys are 64-bit hashes of the normalised texts. A directory of 2^depth slots, by the leading bits
of a key, says which bucket a key belongs to; it is doubled until no bucket is overfull, and a bucket that
needs fewer bits takes several slots. Every bucket has an owner task, which chains the entries of equal
hashes by their bytes. A hash of many rows is spread over several owners, whose chains are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import BROADCAST_BYTES, fits_broadcast
from ..operators.storage import materialize

BUCKET_CAPACITY = 4096

# A hash is hot when it has more than 1/HOT_HASHES of all rows, so there are fewer than HOT_HASHES of them.
HOT_HASHES = 1000
SALTS = 64

# Fixed value: the characters that do not count, [\x20\x09-\x0D].
_IGNORED = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for character in _IGNORED:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def slot(key: Column, depth: int) -> Column:
    """The leading `depth` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """The directory over keys(key): (slot, bucket) and its depth. A bucket is named by its first slot."""
    total = keys.count()
    depth = max(0, (total // capacity).bit_length() - 1)
    while True:
        cells = materialize(keys.groupBy(slot(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("n")), "cells")
        # all 64 bits tell distinct keys apart, so this ends
        if depth == 63 or not cells.where(F.col("n") > capacity).head(1):
            break
        depth += 1
    level = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    prefix = F.expr(f"shiftright(slot, {depth} - level)").alias("prefix")
    nodes = cells.select("slot", "n", level).select("level", prefix, "n").groupBy("level", "prefix").agg(F.sum("n").alias("n"))
    nodes = materialize(nodes, "nodes")
    parents = nodes.where(F.col("n") > capacity).select(
        (F.col("level") + 1).alias("level"), F.col("prefix").alias("parent")
    )
    # a bucket is the first prefix of a key that is not overfull: the root, or one below an overfull prefix
    below = nodes.withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["level", "parent"], "left_semi")
    roots = nodes.where(F.col("level") == 0).withColumn("parent", F.lit(0).cast("long"))
    fits = (F.col("n") <= capacity) | (F.col("level") == depth)
    leaves = below.unionByName(roots.select(below.columns)).where(fits)
    low = F.expr(f"shiftleft(prefix, {depth} - level)")
    high = F.expr(f"shiftleft(prefix + 1, {depth} - level) - 1")
    slots = leaves.select(low.alias("bucket"), F.explode(F.sequence(low, high)).alias("slot"))
    return materialize(slots, "directory"), depth


def exact_groups(
    docs: DataFrame, *, capacity: int = BUCKET_CAPACITY, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Which row of equal texts stays: (doc_id, keep_id, group_size, kept, text_sha256), one row per row.

    `docs` has doc_id and text; other columns are ignored. Texts are equal when identical after deleting
    every character of [\\x20\\x09-\\x0D]; NULL counts as empty. Of equal texts the row with the most code
    points stays, then the one with the smallest doc_id (a NULL doc_id is larger than all others). Rows that
    agree in doc_id, length and normalised text are told apart by nothing and are all kept.
    """
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).alias("length"), normalised(F.col("text")).alias("content"))
    texts = texts.withColumn("key", F.xxhash64("content"))
    entries = materialize(texts.select("doc_id", "length", "key", F.sha2("content", 256).alias("sha")), "entries")
    keys = materialize(entries.groupBy("key").agg(F.count("*").alias("n")), "keys")
    slots, depth = directory(keys, capacity)

    rows = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # fewer than HOT_HASHES rows, whatever the data
    hot = keys.where(F.col("n") * HOT_HASHES > rows).select("key", F.lit(True).alias("hot"))
    owned = texts.withColumn("slot", slot(F.col("key"), depth))
    owned = owned.join(F.broadcast(slots) if fits_broadcast(slots, broadcast_bytes) else slots, "slot")
    owned = owned.join(F.broadcast(hot), "key", "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "length"), F.lit(SALTS))).otherwise(0)
    owned = owned.select("bucket", salt.alias("salt"), "key", "content", "doc_id", "length")

    # the order in which rows stay: longest, then smallest id; NULL ids come last as their complement is NULL
    best = F.max(F.struct("length", F.bitwise_not("doc_id").alias("order")))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chains = (
        owned.repartition(partitions, "bucket", "salt")
        .groupBy("bucket", "salt", "key", "content")
        .agg(best.alias("best"), F.count("*").alias("n"))
        .select("key", F.sha2("content", 256).alias("sha"), "best", "n")
    )
    groups = (
        chains.groupBy("key", "sha")
        .agg(F.max("best").alias("best"), F.sum("n").alias("n"))
        .where(F.col("n") > 1)
    )
    found = F.col("n").isNotNull()
    keep = F.bitwise_not(F.col("best.order"))
    same = F.col("doc_id").eqNullSafe(keep) & (F.col("length") == F.col("best.length"))
    return entries.join(groups, ["key", "sha"], "left").select(
        "doc_id",
        F.when(found, keep).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(found, same).otherwise(True).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
