"""Quality classifier with hierarchical empirical Bayes.

A word classifier, fitted on a bounded sample of labelled rows, gives each document a probability of being
bad. Sites add to it: the mean over a host is shrunk towards the global mean and that over a path towards its
host, the more the sparser the site; how strongly follows from how far sites differ beyond chance. The
document's log-odds are then moved by how its path differs from the global mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import materialize
from .arrays import LOWER, chunks, mix, span_hashes, text_arrays, word_bounds

# At most this many labelled rows are used for fitting: those with the smallest hash of their id.
MOST_LABELLED = 20_000

# The most frequent telling features make up the model; this bounds what the driver and tasks hold.
MOST_FEATURES = 1 << 16

_FEATURE_BITS = 40
# A feature counts when it is this many times as frequent in bad documents as in good ones, and when its
# log-likelihood ratio against chance is this high, as there are many features. Bad documents hold ordinary
# words too, which are not evidence of being good. The likelihood is low enough for features of some three bad
# documents, and a feature's weight is its log-ratio times bad / (bad + _SUPPORT), less for rarer ones; both
# were set on held-out labelled rows.
_LEAST_RATIO = 8.0
_LEAST_LIKELIHOOD = 4.0
_SUPPORT = 2.0
# Documents are rejected at this probability of being bad.
REJECT_AT = 0.9
_MOST_EVIDENCE = 12.0


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text: hashed lower-case words, their first five and last two bytes."""
    data, starts = text_arrays(column)
    raw, data = data, LOWER[data]
    begins, ends, before = word_bounds(data, starts)
    owner = np.repeat(np.arange(len(column)), np.diff(before))
    shift = np.uint64(64 - _FEATURE_BITS)
    kinds = [
        span_hashes(data, begins, ends),
        mix(span_hashes(data, begins, np.minimum(begins + 5, ends)) + np.uint64(1)),
        mix(span_hashes(raw, np.maximum(ends - 2, begins), ends) + np.uint64(2)),
    ]
    # a slice has fewer than 2^23 texts
    keyed = [owner << _FEATURE_BITS | (k >> shift).astype(np.int64) for k in kinds]
    found = np.unique(np.concatenate(keyed))
    return found >> _FEATURE_BITS, found & ((1 << _FEATURE_BITS) - 1)


def fit(
    docs: DataFrame, labels: DataFrame, *, most_labelled: int = MOST_LABELLED
) -> tuple[np.ndarray, np.ndarray, float]:
    """The telling features (sorted), their weights and the prior log-odds, from labels(doc_id, bad).

    NULL labels do not count. Features are counted in Spark; only telling ones reach the driver.
    """
    labels = labels.where("doc_id is not null and bad is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "bad")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            label = part.column("bad").to_numpy(zero_copy_only=False).astype(np.int64)
            owner, feature = features(part.column("text"))
            some, place = np.unique(feature, return_inverse=True)
            bad = np.bincount(place, weights=label[owner], minlength=len(some)).astype(np.int64)
            # the feature -1 counts the documents
            arrays = [np.append(some, -1), np.append(np.bincount(place, minlength=len(some)), len(label)), np.append(bad, label.sum())]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["feature", "n", "bad"])

    sums = labelled.mapInArrow(count, "feature long, n long, bad long").groupBy("feature")
    sums = materialize(sums.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "features")
    all_docs = sums.where("feature = -1").first()
    if all_docs is None or not 0 < all_docs["bad"] < all_docs["n"]:
        # one class only, or no labels: no evidence either way
        return np.empty(0, np.int64), np.empty(0), 0.0
    total, total_bad = all_docs["n"], all_docs["bad"]
    total_good = total - total_bad
    n, bad = F.col("n"), F.col("bad")
    ratio = (bad + 0.5) / (total_bad + 1) / ((n - bad + 0.5) / (total_good + 1))
    likelihood = bad * F.log((bad + 0.5) / (n + 1) * total / total_bad)
    likelihood += (n - bad) * F.log((n - bad + 0.5) / (n + 1) * total / total_good)
    telling = (likelihood > _LEAST_LIKELIHOOD) & (ratio > _LEAST_RATIO)
    weight = F.log(ratio) * bad / (bad + _SUPPORT)
    model = sums.where((F.col("feature") >= 0) & telling).select("feature", n, weight.alias("weight"))
    rows = model.orderBy(F.desc("n"), "feature").limit(MOST_FEATURES).collect()
    rows.sort(key=lambda r: r["feature"])
    prior = float(np.log(total_bad / total_good))
    return np.array([r["feature"] for r in rows], np.int64), np.array([r["weight"] for r in rows], np.float64), prior


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, parent: str) -> DataFrame:
    """One row (strength): how many documents the parent's mean is worth, by the method of moments."""
    parent_mean, mean = F.col(parent), F.col("bad") / F.col("n")
    moments = groups.agg(
        F.sum(F.col("n") * (mean - parent_mean) ** 2).alias("between"),
        F.sum(F.col("n")).alias("n"),
        F.count("*").alias("groups"),
        F.sum(F.col("n") * parent_mean * (1 - parent_mean)).alias("within"),
    )
    chance = F.col("within") / F.col("n")
    excess = (F.col("between") - F.col("groups") * chance) / F.col("n")
    value = F.when(excess > 1e-6 * chance, chance / excess).otherwise(1e6)
    return moments.select(F.coalesce(F.least(F.greatest(value, F.lit(1.0)), F.lit(1e6)), F.lit(1e6)).alias("strength"))


def score_quality(
    docs: DataFrame, labels: DataFrame, *, host: Column | None = None, path: Column | None = None,
    most_labelled: int = MOST_LABELLED, reject_at: float = REJECT_AT,
) -> DataFrame:
    """(doc_id, evidence, host_posterior, path_posterior, bad_probability, kept), one row per row.

    `docs` has doc_id and text, `labels` doc_id and bad (0 or 1); other columns are ignored. `host` and
    `path` are expressions over docs (by default source, and source with lang); NULL is a site of its own.
    `evidence` is the classifier's probability that the document is bad; NULL and empty texts have that of
    the prior. Documents with a probability below `reject_at` are kept. Without labels of both kinds all
    evidence is a half, and all documents are kept.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.col("source"), F.col("lang")) if path is None else path
    telling, weights, prior = fit(docs, labels, most_labelled=most_labelled)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            owner, feature = features(part.column("text"))
            known = np.isin(feature, telling)
            weight = weights[np.searchsorted(telling, feature[known])]
            total = prior + np.bincount(owner[known], weights=weight, minlength=part.num_rows)
            p = 1 / (1 + np.exp(-np.clip(total, -_MOST_EVIDENCE, _MOST_EVIDENCE)))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(p)], ["doc_id", "host", "path", "evidence"])

    sites = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        "text",
    )
    scored = materialize(sites.mapInArrow(classify, "doc_id long, host string, path string, evidence double"), "scored")

    # all tables below have a row per site or a single one
    mean = scored.agg(F.coalesce(F.avg("evidence"), F.lit(0.5)).alias("overall"))
    sums = (F.count("*").alias("n"), F.sum("evidence").alias("bad"))
    hosts = scored.groupBy("host").agg(*sums).join(F.broadcast(mean))
    hosts = hosts.join(F.broadcast(_strength(hosts, "overall"))).select(
        "host", "overall", ((F.col("bad") + F.col("strength") * F.col("overall")) / (F.col("n") + F.col("strength"))).alias("host_posterior")
    )
    paths = scored.groupBy("host", "path").agg(*sums).join(hosts, "host")
    paths = paths.join(F.broadcast(_strength(paths, "host_posterior"))).select(
        "host", "path", "overall", "host_posterior",
        ((F.col("bad") + F.col("strength") * F.col("host_posterior")) / (F.col("n") + F.col("strength"))).alias("path_posterior"),
    )
    odds = _logit(F.col("evidence")) + _logit(F.col("path_posterior")) - _logit(F.col("overall"))
    probability = 1 / (1 + F.exp(-odds))
    return scored.join(paths, ["host", "path"]).select(
        "doc_id", "evidence", "host_posterior", "path_posterior", probability.alias("bad_probability"),
        (probability < reject_at).alias("kept"),
    )
