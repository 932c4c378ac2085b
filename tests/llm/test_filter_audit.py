"""The filter audit against filters applied one after the other, and the SQL of its query."""

import itertools
import random
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest

from glyphgraph.llm import catalogue, filter_audit, oracle

DOCS = "doc_id long, text string, lang string, part string, failed int, digest string, first boolean, good int"


def documents(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)] + ["NASA", "é", "a|b", "😀"]
    texts = [None, "", " \n", "$", "A" * 5000, "w " * 400]
    for _ in range(60):
        pool = words[: rng.choice([1, 3, 100, 154])]
        text = rng.choice([" ", "\n", "\t "]).join(rng.choices(pool, k=rng.choice([0, 5, 99, 100, 101, 140])))
        texts.append(text.upper() if rng.random() < 0.2 else text)
    texts += [" ".join(words[:k]) for k in (99, 100, 101)]
    ids = [*range(n - 10), *range(5), None, None, None, 1, 2]
    return [(i, rng.choice(texts), rng.choice(["en", "de", "", None]), "p", 3, "x", True, 7) for i in ids]


def labels(seed, n=300):
    rng = random.Random(seed)
    rows = [(rng.choice([*range(n), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(200)]
    return [(*r, 1) for r in rows]


def one_by_one(docs, marks):
    good, toxic = ({d for d, *m, _ in marks if d is not None and m[k] == 1} for k in (0, 1))
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = defaultdict(list)
    for i, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and first[text] < i,
        }
        parts[lang or ""].append(({f for f, bad in failed.items() if bad}, i in good, i in toxic))
    rows = []
    for part, members in parts.items():
        removed_by, steps = defaultdict(int), []
        for order in itertools.permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                hit = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                removed_by[f] += len(hit)
                redundant = sum(f in m[0] for m in members) - len(hit)
                unique = sum(m[0] == {f} for m in members)
                good_lost, toxic_lost = sum(m[1] for m in hit), sum(m[2] for m in hit)
                steps.append([part, "".join(order), step, len(left), len(hit), redundant, unique, good_lost, toxic_lost, f])
        rows += [(*s[:-1], removed_by[s[-1]]) for s in steps]
    return sorted(rows)


def frames(spark, docs, marks):
    return (
        spark.createDataFrame(docs, DOCS).repartition(3),
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int, n int").repartition(2),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_steps_of_all_orders(spark, seed):
    catalogue.find_package(spark)
    docs, marks = documents(seed), labels(seed)
    found = filter_audit.audit_filters(*frames(spark, docs, marks))
    assert sorted(map(tuple, found.collect())) == one_by_one(docs, marks)


def test_empty_tables(spark):
    catalogue.find_package(spark)
    assert filter_audit.audit_filters(*frames(spark, [], [])).count() == 0
    found = filter_audit.audit_filters(*frames(spark, documents(3)[:1], []))
    assert found.count() == 600


def test_shares_solve_the_least_squares_problem():
    rng = random.Random(4)
    for filters in (2, 3, 5):
        counts = {m: rng.randrange(50) for m in range(1 << filters)}
        values = filter_audit.removals(counts, filters)
        orders = list(itertools.permutations(range(filters)))
        share = [Fraction(0)] * filters
        for order in orders:
            before = 0
            for i in order:
                share[i] += Fraction(values[before | 1 << i] - values[before], len(orders))
                before |= 1 << i
        assert filter_audit.shapley_shares(values) == share


def test_registered_query_and_its_sql(spark, tmp_path):
    docs, marks = documents(5), labels(5)
    connection = duckdb.connect()
    for name, frame in zip(("documents", "labels"), frames(spark, docs, marks), strict=True):
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
        connection.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    found = catalogue.all_queries()["op12_filter_audit"](spark, str(tmp_path))
    result = connection.execute(oracle.all_sql()["op12_filter_audit"])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(result.fetchall())
