"""Every registered query against its SQL on a small table."""

import random

import duckdb
import pytest

import __spark_entry__ as entry_points
from glyphgraph import catalogue, oracle

NAMES = sorted(catalogue.all_queries())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    alphabet = "很好不错电脑，。 aé7'\\😀\n"
    texts = [
        "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 5, 20, 51, 52, 80]))) for _ in range(400)
    ]
    # a character that nothing leads to, and one that leads to nothing
    texts[7], texts[8] = "始好", "好终"
    path = tmp_path_factory.mktemp("tables")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.coalesce(1).write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    connection.execute(
        f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')"
    )
    return connection


def test_every_query_has_sql():
    assert NAMES == sorted(oracle.all_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, folder, duck, name):
    frame = entry_points.queries()[name](spark, folder)
    result = duck.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    found = [tuple(r) for r in frame.select(columns).collect()]
    expected = result.fetchall()
    assert found
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_ordered_queries(spark, folder):
    for name in ("bigram_edges", "bigram_top_k"):
        rows = entry_points.queries()[name](spark, folder).collect()
        keys = [(-r["weight"], r["src"].encode(), r["dst"].encode()) for r in rows]
        assert keys == sorted(keys)


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns == ["comment_id", "segmented"]
    assert frame.count() == 200
