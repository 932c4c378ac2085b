"""Characters and pairs made inside the tasks are those of the DataFrame operators."""

import random
import re

import pytest

from glyphgraph import catalogue
from glyphgraph.plans import comments as texts
from glyphgraph.plans import corpus as corpora
from glyphgraph.plans import expanding, segmentation


def rows(frame):
    return sorted(map(repr, frame.collect()))


@pytest.fixture(scope="module")
def odd(comments):
    rng = random.Random(3)
    # more letters than are counted in a table, and a text of several stretches
    many = ["".join(chr(rng.randrange(0x4E00, 0x4E00 + 900)) for _ in range(300)) for _ in range(20)]
    few = ["".join(rng.choice("很好不错电脑 ，aé7\\😀\n\0") for _ in range(rng.randrange(60))) for _ in range(60)]
    long = "".join(rng.choice("很好a😀") for _ in range(140_000))
    return comments("", None, "x", "😀", "ab", *many, *few, long, (None, "a好b"), (7, "ab"), (7, "ab")).repartition(3)


def test_pairs_are_counted_alike(odd, monkeypatch):
    expected = corpora.bigram_edges(odd)
    found = corpora.counted_pairs(odd)
    assert found.schema == expected.schema
    assert rows(found) == rows(expected)


def test_a_task_gives_on_what_it_does_not_hold(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(expanding, "_COUNTED", 4)
    monkeypatch.setattr(expanding, "_HELD", 3)
    body = ["abcd", "efgh", "abab", "", "h", "xyz"]
    batch = pa.RecordBatch.from_pydict({"body": body, "after": pa.array([None, "i", None, None, None, None], pa.string())})
    counted = {}
    for part in expanding.count_pairs(iter([batch, batch])):
        for src, dst, n in zip(*(part.column(c).to_pylist() for c in ("src", "dst", "n")), strict=True):
            counted[src + dst] = counted.get(src + dst, 0) + n
    assert counted == {**{p: 2 for p in ("bc", "cd", "ef", "fg", "gh", "hi", "ba", "xy", "yz")}, "ab": 6}


def test_characters_and_edges_are_alike(odd):
    corpus = corpora.bigram_edges(odd).localCheckpoint()
    for make in (segmentation.label_characters, texts.weighted_edges):
        expected, found = make(odd, corpus), make(odd, corpus, in_tasks=True)
        assert found.dtypes == expected.dtypes
        assert rows(found) == rows(expected)


def test_queries_make_their_characters_in_the_tasks(spark, tmp_path):
    spark.createDataFrame([(1, "ab"), (2, "很好")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("label_chars", "export_nodes", "weighted_comment_edges"):
        plan = catalogue.all_queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan
        # texts are cut into stretches, and nothing else is made rows of in the JVM
        assert re.findall(r"Generate (\w+)\((\w+)", plan) == [("posexplode", "units")]
