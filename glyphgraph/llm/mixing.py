"""Mixing to target weights with soft membership, in DataFrame operations only.

A naive Bayes classifier over telling words and word endings, fitted on a bounded sample of labelled rows, gives
every document posteriors over the domains; what a document lacks is no evidence. Projected gradient steps then fit a rate of at least zero to each
document, so that the tokens each domain is expected to get match the targets: a step needs the domains'
totals, one distributed sum each, and moves every rate by its document's posteriors alone.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import let
from ..operators.lookup import lookup_join
from ..operators.storage import Tables, materialize

# The classifier is fitted on at most this many labelled rows: those with the smallest hash of their id.
MOST_LABELLED = 4_000
# A feature counts when so many labelled rows have it.
SUPPORT = 3
# Endings of so many characters are features besides words.
_ENDINGS = (2, 3)
# Steps end when every domain's total is within this share of its goal, or when no step brings them nearer.
TOLERANCE = 1e-6

_WORD = r"[^\x20\x09-\x0D]+"


def _described(text: Column) -> Column:
    """(n_tokens, features): the number of a text's words; the distinct lower-case words and their endings, as hashes.

    Each kind of feature has hashes of its own.
    """

    def hashed(found: Column) -> Column:
        ends = [F.transform(found, lambda w, n=n: F.xxhash64(F.right(w, F.lit(n)), F.lit(n))) for n in _ENDINGS]
        return F.array_distinct(F.concat(F.transform(found, lambda w: F.xxhash64(w)), *ends))

    def described(words: Column) -> Column:
        features = let(F.array_distinct(words), hashed)
        return F.struct(F.size(words).cast("long").alias("n_tokens"), features.alias("features"))

    return let(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)), described)


def fit_domains(labelled: DataFrame, *, most_labelled: int = MOST_LABELLED) -> tuple[list, DataFrame | None]:
    """Domains with their shares, and (feature, w0, w1, ...) with log-likelihoods by domain, from (doc_id, text, domain)."""
    sample = labelled.where("domain is not null and text is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    sample = materialize(sample, "labelled")
    domains = [(r["domain"], r["n"]) for r in sample.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").collect()]
    if not domains:
        return [], None
    total = sum(n for _, n in domains)
    held = sample.select("domain", F.explode(_described(F.col("text"))["features"]).alias("feature"))
    held = held.groupBy("feature").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, (d, _) in enumerate(domains)]
    )
    logs = [F.log((F.col(f"n{i}") + 0.5) / (n + 1)).alias(f"w{i}") for i, (_, n) in enumerate(domains)]
    telling = held.where(F.col("n") >= SUPPORT).select("feature", *logs)
    return [(d, n / total) for d, n in domains], materialize(telling, "telling")


def _with_posteriors(frame: DataFrame, domains: list, telling: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, posteriors) from (doc_id, text), one row per row."""
    # all features of a row are in one task, so they are combined there and a row a document is shuffled
    found = frame.select(F.monotonically_increasing_id().alias("_row"), "doc_id", _described(F.col("text")).alias("_found"))
    held = found.select("_row", "doc_id", "_found.n_tokens", F.explode_outer("_found.features").alias("feature"))
    sums = [F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"w{i}") for i in range(len(domains))]
    summed = lookup_join(held, telling, "feature").groupBy("_row", "doc_id", "n_tokens").agg(*sums)
    # each step is a column, so that none is computed again
    frame = summed.withColumn("_odds", F.array(*(F.col(f"w{i}") + math.log(share) for i, (_, share) in enumerate(domains))))
    frame = frame.withColumn("_most", F.array_max("_odds"))
    frame = frame.withColumn("_weights", F.transform("_odds", lambda o: F.exp(o - F.col("_most"))))
    frame = frame.withColumn("_sum", F.aggregate("_weights", F.lit(0.0), lambda a, x: a + x))
    return frame.select("doc_id", "n_tokens", F.transform("_weights", lambda w: w / F.col("_sum")).alias("posteriors"))


def fit_rates(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, most_labelled: int = MOST_LABELLED
) -> DataFrame:
    """A rate for every document: (doc_id, n_tokens, posteriors, rate), one row per row.

    `docs` has doc_id and text, `labelled` doc_id, text and domain; other columns are ignored. `targets`
    are weights by domain, scaled so that no domain has to shrink: mixing repeats documents of domains that are short
    and drops none for being in one that is not. A domain without a target keeps the tokens it has, and the targets
    share what is left. NULL and empty texts have no tokens and the domains' shares as posteriors. Posteriors are in
    the order of the domains' names. Without labelled rows, or if no target names a domain, every rate is one.

    Where no nonnegative rates meet all goals, as when a domain only occurs beside others, the rates are those of
    the least squares of what is left.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    domains, telling = fit_domains(labelled, most_labelled=most_labelled)
    names = [d for d, _ in domains]
    wanted = [max(0.0, targets.get(d, 0.0)) for d in names]
    if not sum(wanted):
        none = F.expr("array()").cast("array<double>").alias("posteriors")
        n_tokens = F.regexp_count("text", F.lit(_WORD)).cast("long").alias("n_tokens")
        return base.select("doc_id", n_tokens, none, F.lit(1.0).alias("rate"))
    scored = _with_posteriors(base, domains, telling)
    k = range(len(names))
    share, one = F.col("posteriors"), F.lit(1.0).alias("rate")

    def totals(frame: DataFrame) -> np.ndarray:
        own = [F.coalesce(F.sum(F.col("rate") * F.col("n_tokens") * share[i]), F.lit(0.0)).alias(f"t{i}") for i in k]
        return np.array(list(frame.agg(*own).first()))

    with Tables(docs.sparkSession) as tables:
        current = tables.write(scored.select("*", one), "rates-0")
        # the targets' Gram matrix scales the gradient, so that a step without clipping meets them at once
        pairs = [(i, j) for i in k for j in k]
        sums = [F.coalesce(F.sum(F.col("n_tokens") * share[i] * share[j]), F.lit(0.0)) for i, j in pairs]
        gram = np.array(list(current.agg(*(x.alias(f"g{n}") for n, x in enumerate(sums))).first())).reshape(len(names), -1)
        now = totals(current)
        goal = _goals(now, wanted)
        kept, step, tries = "rates-0", 1.0, 0
        while np.abs(goal - now).max() > TOLERANCE * max(goal.max(), 1.0) and step > 1e-3:
            scaled = np.linalg.lstsq(gram, goal - now, rcond=None)[0] * step
            move = sum((share[i] * float(c) for i, c in enumerate(scaled)), F.lit(0.0))
            tries += 1
            moved = tables.write(current.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") + move)), f"rates-{tries}")
            then = totals(moved)
            # a step that does not come a little nearer is tried again at half its length
            if np.linalg.norm(goal - then) < (1 - 1e-4) * np.linalg.norm(goal - now):
                tables.drop(kept)
                current, now, kept, step = moved, then, f"rates-{tries}", min(1.0, 2 * step)
            else:
                tables.drop(f"rates-{tries}")
                step /= 2
        tables.keep(kept)
        return current


def _goals(tokens: np.ndarray, wanted: list[float]) -> np.ndarray:
    """The tokens each domain should have: targets in proportion, no domain below what it has, others as they are."""
    weights = np.array(wanted) / sum(wanted)
    named = weights > 0
    whole = (tokens[named] / weights[named]).max()
    return np.where(named, weights * whole, tokens)


def apply_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """`docs` with each row as often as its rate says: its whole part, and once more with the chance of the rest.

    Chance is a hash of doc_id, so a run repeats. Every row stays at least once, so the written mix exceeds a goal by
    what rates below one are rounded up. Rows that share a doc_id (or have none) have the highest of its rates.
    """
    key, rate = (f"{name}_{uuid.uuid4().hex}" for name in ("doc", "rate"))
    highest = rates.groupBy(F.col("doc_id").alias(key)).agg(F.max("rate").alias(rate))
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mix")), F.lit(1 << 20)) / float(1 << 20)
    whole = F.floor(F.coalesce(rate, F.lit(1.0)))
    copies = F.greatest(whole + F.when(chance < F.coalesce(rate, F.lit(1.0)) - whole, 1).otherwise(0), F.lit(1))
    joined = docs.join(highest.hint("merge"), F.col("doc_id").eqNullSafe(F.col(key)), "left")
    each = F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias(rate)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], each).drop(rate)
