"""The queries of this subpackage. Each takes (spark, folder of parquet tables) and gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import find_package
from . import ann, bpe, conversations, embedding_dedup, exact, filter_audit, line_dedup, mixing, partenum, quality, secret_scan, substring, suffix

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    _QUERIES[build.__name__] = build
    return build


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents")


@_query
def op1_bpe_encoding(spark, folder):
    return bpe.encode_texts(
        _documents(spark, folder),
        public_tokenizers.path("byte_bpe_50k.json"),
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


@_query
def op2_secret_scans(spark, folder):
    secrets = F.col("secrets")

    def count(number: int):
        return F.size(F.filter(secrets, lambda s: s["number"] == number)).cast("long")

    counts = [count(n).alias(f"n_{r.kind}") for n, r in enumerate(secret_scan.RULES)]
    # the production rules are the base ones, so all spans are base spans
    spans = secret_scan.written(secrets)
    return secret_scan.find_secrets(_documents(spark, folder)).select(
        "doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans")
    )


@_query
def op3_ngram_jaccard_join(spark, folder):
    return partenum.ngram_components(_documents(spark, folder))


@_query
def op4_substring_dedup(spark, folder):
    kept = substring.remove_repeats(_documents(spark, folder))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


# The weights that the mixture should have, by language.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled documents with their language as domain."""
    known = labels.select("doc_id").where("doc_id is not null").distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(mixing.MOST_LABELLED)
    return docs.select("doc_id", "text", F.col("lang").alias("domain")).join(F.broadcast(chosen), "doc_id", "left_semi")


@_query
def op5_mixing(spark, folder):
    docs = _documents(spark, folder)
    return mixing.fit_rates(docs, labelled_domains(docs, _table(spark, folder, "labels")), TARGETS)


@_query
def op6_exact_dedup(spark, folder):
    return exact.exact_groups(_documents(spark, folder))


@_query
def op7_line_dedup(spark, folder):
    kept = line_dedup.remove_similar_lines(_documents(spark, folder))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@_query
def op8_suffix_array_dedup(spark, folder):
    kept = suffix.remove_repeated_bytes(_documents(spark, folder))
    return kept.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query
def op9_nearest_neighbours(spark, folder):
    return ann.nearest(_table(spark, folder, "embeddings"))


def bad_labels(labels: DataFrame) -> DataFrame:
    """A labelled document is bad when it is of low quality or toxic."""
    return labels.select("doc_id", F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))


@_query
def op10_quality_classifier(spark, folder):
    return quality.score_quality(_documents(spark, folder), bad_labels(_table(spark, folder, "labels")))


@_query
def op11_conversation_repair(spark, folder):
    return conversations.repair_conversations(_table(spark, folder, "conversations"))


@_query
def op12_filter_audit(spark, folder):
    return filter_audit.audit_filters(_documents(spark, folder), _table(spark, folder, "labels"))


@_query
def op13_embedding_dedup(spark, folder):
    return embedding_dedup.near_duplicates(_table(spark, folder, "embeddings"))
