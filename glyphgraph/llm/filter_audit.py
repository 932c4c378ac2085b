"""Which filter removes what: every order of a set of filters, and each filter's Shapley share.

Every document is tested by all filters at once, so a document is a set of failed filters. Counting the documents
of each set gives, for every coalition of filters, how many documents it removes: 32 coalitions for five filters,
whatever the number of documents. Differences of coalitions are the steps of all orders. The Shapley shares are the
solution of a weighted least-squares problem over the coalitions, in which the shares add up to what all filters
remove together; its normal equations are solved in rationals.

NULL texts count as empty. A document without id is in no order to others, so it is a copy of none and none
of it. Rows that share an id and a text are not copies of one another; each row counts. A document is good
(toxic) when any row of the labels says so. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from itertools import permutations
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import materialize

# The filters, in the order of their bits, and the bounds of their tests.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = "[#$%&*|]"
SEPARATORS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_STEP = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long,"
    " good_lost long, toxic_lost long, shapley long"
)


def failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails, from the text alone."""
    words = F.filter(F.split(text, SEPARATORS), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))

    def bits(words: Column) -> Column:
        n = F.size(words)
        tests = [
            n < LEAST_WORDS,
            100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
            100 * capitals.cast("long") > MOST_CAPITALS * F.char_length(text).cast("long"),
            text.rlike(SYMBOLS),
        ]
        return sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)), F.lit(0))

    # through an array, so that the words are found once
    return F.transform(F.array(words), bits)[0]


def failed_sets(docs: DataFrame, labels: DataFrame, *, part: str = "lang") -> DataFrame:
    """How many documents fail each set of filters: (part, failed, good, toxic, n)."""
    text = F.coalesce("text", F.lit(""))
    tested = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        failures(text).alias("failed"),
    )
    tested = materialize(tested, "tested")
    # a text's first document; joined by id as well as text, so a text of very many copies is no hot key
    known = tested.where("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    joined = tested.join(first.hint("merge"), ["digest", "doc_id"], "left").join(marks.hint("merge"), "doc_id", "left")
    copied = F.col("first").isNull() & F.col("doc_id").isNotNull()
    failed = F.col("failed") + F.when(copied, 1 << FILTERS.index("E")).otherwise(0)
    good, toxic = F.coalesce("good", F.lit(False)), F.coalesce("toxic", F.lit(False))
    return joined.groupBy("part", failed.alias("failed"), good.alias("good"), toxic.alias("toxic")).agg(F.count("*").alias("n"))


def removals(counts: dict[int, int], filters: int) -> list[int]:
    """For every coalition of filters, how many documents fail at least one of them."""
    return [sum(n for failed, n in counts.items() if failed & coalition) for coalition in range(1 << filters)]


@cache
def _solved_kernel(filters: int) -> list[list[Fraction]]:
    """The rows that turn coalition values into shares: the inverse of the constrained normal equations.

    Minimised is the sum over all coalitions but the empty and the whole one of weight * (value - shares in it)
    squared, where all shares add up to the value of the whole. The last unknown is the multiplier of that bond.
    """
    size, whole = filters + 1, (1 << filters) - 1
    left = [[Fraction(0)] * size for _ in range(size)]
    right = [[Fraction(0)] * (whole + 1) for _ in range(size)]
    for coalition in range(1, whole):
        inside = [i for i in range(filters) if coalition >> i & 1]
        weight = Fraction(filters - 1, comb(filters, len(inside)) * len(inside) * (filters - len(inside)))
        for i in inside:
            right[i][coalition] += weight
            for j in inside:
                left[i][j] += weight
    for i in range(filters):
        left[i][filters] = left[filters][i] = Fraction(1)
    right[filters][whole] = Fraction(1)
    rows = [a + b for a, b in zip(left, right, strict=True)]
    for i in range(size):
        pivot = next(r for r in range(i, size) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(size):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [row[size:] for row in rows[:filters]]


def shapley_shares(values: list[int]) -> list[Fraction]:
    """Each filter's share of what all remove together, from the values of all coalitions."""
    filters = (len(values) - 1).bit_length()
    return [sum((a * v for a, v in zip(row, values, strict=True)), Fraction(0)) for row in _solved_kernel(filters)]


def audit_orders(counts: list[tuple[int, bool, bool, int]]) -> Iterator[tuple]:
    """Every step of every order from (failed, good, toxic, n): the columns after `part`."""

    def total(keep) -> dict[int, int]:
        sums: dict[int, int] = {}
        for failed, good, toxic, n in counts:
            if keep(good, toxic):
                sums[failed] = sums.get(failed, 0) + n
        return sums

    everything = total(lambda good, toxic: True)
    size = len(FILTERS)
    gone = removals(everything, size)
    gone_good = removals(total(lambda good, toxic: good), size)
    gone_toxic = removals(total(lambda good, toxic: toxic), size)
    rows = sum(everything.values())
    orders = list(permutations(range(size)))
    shares = [share * len(orders) for share in shapley_shares(gone)]
    for order in orders:
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            yield (
                name,
                step,
                rows - gone[after],
                removed,
                gone[1 << i] - removed,
                everything.get(1 << i, 0),
                gone_good[after] - gone_good[before],
                gone_toxic[after] - gone_toxic[before],
                int(shares[i]),
            )
            before = after


def audit_filters(docs: DataFrame, labels: DataFrame, *, part: str = "lang") -> DataFrame:
    """A row per part, order of the filters and step.

    A part's task receives at most one row per set of failed filters and label, 128 in all.
    """

    def steps(table: pa.Table) -> pa.Table:
        counts = list(zip(*(table[c].to_pylist() for c in ("failed", "good", "toxic", "n")), strict=True))
        rows = list(zip(*audit_orders(counts), strict=True))
        names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
        columns = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
        here = pa.array([table["part"][0].as_py()] * len(columns[0]), pa.string())
        return pa.table([here, *columns], ["part", *names])

    return failed_sets(docs, labels, part=part).groupBy("part").applyInArrow(steps, _STEP)
