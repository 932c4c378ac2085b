"""The physical plans that the design rests on."""

import importlib
import re

import pytest

from pyspark.sql import functions as F

from glyphgraph.operators import Tables, characters
from glyphgraph.operators.graph import combine_messages
from glyphgraph.plans import corpus as corpora
from glyphgraph.plans import segmentation
from glyphgraph.plans.comments import comment_slice, weighted_edges

# the package gives the name to the function
pregel_module = importlib.import_module("glyphgraph.operators.pregel")


@pytest.fixture
def stored(spark, tmp_path, monkeypatch):
    """Comments that count as a big table, which has splits enough for all cores."""
    monkeypatch.setattr(characters, "SPLIT_BYTES", 0)
    path = str(tmp_path / "comments")
    rows = spark.range(64).selectExpr(
        "id as comment_id", "repeat('很好不错', 5) as content", "'x' as other"
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return re.findall(r"(?<!Broadcast)Exchange (\w+)\(", plan)


def test_labels_need_no_shuffle(stored, sample_corpus):
    plan = plan_of(segmentation.label_characters(stored, sample_corpus))
    assert exchanges(plan) == []
    assert plan.count("BroadcastHashJoin") == 2
    assert "ReadSchema: struct<comment_id:bigint,content:string>" in plan


def test_weights_need_no_shuffle(stored, sample_corpus):
    plan = plan_of(weighted_edges(stored, sample_corpus))
    assert exchanges(plan) == []
    assert plan.count("BroadcastHashJoin") == 1


def test_pairs_are_counted_before_the_only_shuffle(stored):
    plan = plan_of(corpora.bigram_edges(stored))
    assert exchanges(plan) == ["hashpartitioning"]
    assert "partial_count" in plan
    assert plan.index("Exchange") < plan.index("partial_count")
    assert "ReadSchema: struct<content:string>" in plan


def test_a_small_table_is_dealt_out_to_all_cores(spark, stored, monkeypatch):
    monkeypatch.setattr(characters, "SPLIT_BYTES", 128 << 20)
    plan = plan_of(characters.all_characters(stored))
    assert exchanges(plan) == ["hashpartitioning"]
    assert "Generate" not in plan.split("Exchange")[1]


def test_text_is_cut_once(stored):
    """No derived filter repeats the splitting."""
    plan = plan_of(corpora.bigram_edges(stored))
    # long texts are split to be cut into stretches, and every stretch into its characters
    assert plan.count("split(") == 2
    assert plan.count("regexp_extract_all(") == 0


def text_scans(plan):
    return plan.count("content:string")


def test_segmenting_reads_texts_once_and_makes_no_rows_of_characters(stored, sample_corpus):
    plan = plan_of(segmentation.segment_texts(stored, sample_corpus))
    # what moves are the segmented stretches, when they come together
    assert exchanges(plan) == ["hashpartitioning"]
    assert "Join" not in plan
    assert text_scans(plan) == 1
    # texts are cut into stretches, and nothing else is made rows of
    assert re.findall(r"Generate (\w+)\((\w+)", plan) == [("posexplode", "units")]


def test_a_big_corpus_meets_the_different_pairs_of_a_stretch(spark, stored, sample_corpus):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for make in (segmentation.label_characters, segmentation.segment_texts):
            frame = make(stored, sample_corpus, broadcast_bytes=0)
            plan = plan_of(frame)
            # one lookup of what is different, and one join that brings the dictionary to its stretch
            assert plan.count("SortMergeJoin") == 2
            assert plan.count("BroadcastHashJoin") == 0
            looked_up = [p for p in above(plan, "FileScan") if any("SortMergeJoin [pair" in o for o in p)]
            assert any("posexplode(array_distinct" in o for p in looked_up for o in p)
            assert not any("posexplode(chars" in o for p in looked_up for o in p)
            frame.collect()
            assert text_scans(plan_of(frame).split("Initial Plan")[0]) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def above(plan, marker):
    """The operators on the way from the leaves that hold `marker` up to the root, one list per leaf."""
    paths, stack = [], []
    for line in plan.splitlines():
        depth = len(re.match(r"[\s:|+\-]*", line).group())
        stack = [entry for entry in stack if entry[0] < depth]
        stack.append((depth, line.strip(" :|+-")))
        if marker in line:
            paths.append([operator for _, operator in stack])
    return paths


@pytest.mark.parametrize("direction", ["all", "out", "in", "either", "both"])
def test_a_round_of_a_vertex_program_moves_no_edges(spark, direction):
    """Beyond the broadcast bound vertices go to the edges, which stay in their buckets."""
    vertices = spark.range(100).selectExpr("id", "id as low")
    edges = spark.range(500).selectExpr("id % 100 as src", "(id * 7 + 3) % 100 as dst")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Tables(spark) as tables, pregel_module.meeting_in_place(spark):
            state = pregel_module._State(tables, vertices, 0)
            placed = pregel_module._Edges(tables, edges, placed=True)
            state.lie_with(placed)
            state.active_bytes = 1 << 40
            frame = pregel_module.sending_triplets(state, placed, direction, ("src", "dst"))
            messages = combine_messages(frame, F.col("src_low"), None, F.min("msg"))
            for rows, moves in ((frame, 0), (messages, 1)):
                scans = [p for p in above(plan_of(rows), "FileScan") if "dst#" in p[-1]]
                assert len(scans) == 1 and "Bucketed: true" in scans[0][-1]
                moved = [i for i, operator in enumerate(scans[0]) if operator.startswith("Exchange")]
                # what moves are messages, after they were combined
                assert len(moved) == moves
                assert all("partial_min" in scans[0][i + 1] for i in moved)
            assert frame.count() == 500
            assert frame.where("src_low = src and dst_low = dst").count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_deep_slice_orders_ids_only_and_keeps_none_of_what_it_skips(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 30_000_000, 1, 16).selectExpr("id * 3 % 30000000 as comment_id", "'x' as content").where(
        "comment_id % 2 = 0"
    ).write.parquet(path)
    frame = comment_slice(spark.read.parquet(path), skip=10_000_000, limit=5)
    plan = plan_of(frame)
    # the slice's rows are sorted, not the table: the bounds of the slice are in the scan's filter
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan
    # every multiple of six is there three times: the slice begins and ends within ties
    scan = frame._jdf.queryExecution().optimizedPlan().toString()
    low, high = (int(re.search(rf"comment_id#\d+L {sign} (\d+)", scan).group(1)) for sign in (">=", "<="))
    assert (low, high) == (20_000_004, 20_000_010)
    found = [r["comment_id"] for r in frame.collect()]
    assert found == [20_000_004] * 2 + [20_000_010] * 3


@pytest.mark.parametrize("limit", [0, 1 << 28])
def test_no_plan_pairs_everything(stored, sample_corpus, limit):
    for frame in (
        segmentation.segment_texts(stored, sample_corpus, broadcast_bytes=limit),
        segmentation.label_characters(stored, sample_corpus, broadcast_bytes=limit),
    ):
        plan = plan_of(frame)
        assert "CartesianProduct" not in plan
        assert "NestedLoop" not in plan


def test_top_edges_keep_k_rows_per_task(stored):
    assert "TakeOrderedAndProject(limit=300" in plan_of(
        corpora.top_edges(corpora.bigram_edges(stored))
    )
