import importlib
import random

import pytest
from pyspark.sql import functions as F

from glyphgraph.operators import Graph, dense_ids, lookup_join, pregel
from glyphgraph.operators import lookup as lookup_module
from glyphgraph.plans.comments import comment_graph
from glyphgraph.plans.corpus import corpus_graph, edges_with_ids, vertex_ids


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_degrees(cyclic_graph):
    assert rows(cyclic_graph.out_degrees()) == [(i, 1) for i in range(1, 6)]
    assert rows(cyclic_graph.in_degrees()) == [(2, 1), (3, 1), (4, 2), (5, 1)]


def test_sources_and_sinks(cyclic_graph):
    assert rows(cyclic_graph.sources()) == [(1, "电")]
    assert rows(cyclic_graph.sinks()) == []
    assert rows(cyclic_graph.members(cyclic_graph.sources())) == [(1, "电")]


def test_reverse(cyclic_graph):
    assert rows(cyclic_graph.reverse().edges) == [(2, 1, 3), (3, 2, 1), (4, 3, 3), (4, 5, 10), (5, 4, 2)]
    assert rows(cyclic_graph.reverse().reverse().edges) == rows(cyclic_graph.edges)


@pytest.mark.parametrize("limit", [lookup_module.BROADCAST_BYTES, 0])
def test_triplets(cyclic_graph, limit):
    found = cyclic_graph.triplets(broadcast_bytes=limit).select("src", "src_name", "dst", "dst_name", "weight")
    assert rows(found) == [
        (1, "电", 2, "脑", 3),
        (2, "脑", 3, "真", 1),
        (3, "真", 4, "好", 3),
        (4, "好", 5, "用", 2),
        (5, "用", 4, "好", 10),
    ]


def test_map_and_join_vertices(spark, cyclic_graph):
    graph = cyclic_graph.map_vertices(label=F.lit("A"), n=F.lit(0))
    table = spark.createDataFrame([(4, "U"), (5, None), (99, "X")], "id long, label string")
    joined = graph.join_vertices(table)
    assert rows(joined.vertices) == [(1, "A", 0), (2, "A", 0), (3, "A", 0), (4, "U", 0), (5, None, 0)]
    assert rows(graph.map_edges(w=F.col("weight") * 2).edges)[0] == (1, 2, 6)


def test_build_fills_endpoints_and_keeps_parallel_edges(spark):
    vertices = spark.createDataFrame([(1, "b"), (1, "a"), (7, "z")], "id long, name string")
    edges = spark.createDataFrame([(1, 2, 5), (1, 2, 6)], "src long, dst long, weight long")
    graph = Graph.build(vertices, edges)
    assert rows(graph.vertices) == [(1, "a"), (2, None), (7, "z")]
    assert rows(graph.edges) == [(1, 2, 5), (1, 2, 6)]


def test_aggregate_messages(cyclic_graph):
    sums = cyclic_graph.aggregate_messages(F.sum("msg").alias("w"), to_dst=F.col("weight"))
    assert rows(sums) == [(2, 3), (3, 1), (4, 13), (5, 2)]
    both = cyclic_graph.aggregate_messages(
        F.array_join(F.sort_array(F.collect_list("msg")), "::").alias("names"),
        to_dst=F.col("src_name"),
        to_src=F.when(F.col("weight") > 5, F.col("dst_name")),
        ends=("src", "dst"),
    )
    assert rows(both) == [(2, "电"), (3, "脑"), (4, "用::真"), (5, "好::好")]


def test_pregel_on_a_cycle_at_the_round_limit(cyclic_graph):
    graph = cyclic_graph.map_vertices(n=F.lit(0).cast("long"))

    def counted(**limit):
        return pregel(
            graph,
            F.lit(0).cast("long"),
            lambda message: {"n": F.col("n") + message},
            merge=F.sum,
            to_dst=F.lit(1).cast("long"),
            direction="out",
            ends=(),
            **limit,
        )

    assert rows(counted(max_rounds=4, allow_unfinished=True).vertices) == simulate_counts(4)
    with pytest.raises(RuntimeError, match="4 rounds"):
        counted(max_rounds=4)


def simulate_counts(limit):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 4)]
    n = dict.fromkeys(range(1, 6), 0)
    active = set(n)
    for _ in range(limit):
        got = {}
        for s, d in edges:
            if s in active:
                got[d] = got.get(d, 0) + 1
        if not got:
            break
        for v, m in got.items():
            n[v] += m
        active = set(got)
    return sorted(n.items(), key=str)


@pytest.mark.parametrize("direction", ["out", "in", "either", "both"])
@pytest.mark.parametrize("limit", [lookup_module.BROADCAST_BYTES, 0])
def test_pregel_directions(spark, direction, limit):
    """Smallest label over the edges: each direction against a plain restatement."""
    pairs = [(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 7)]
    start = {i: 10 - i for i in range(1, 8)}
    vertices = spark.createDataFrame(list(start.items()), "id long, low long")
    edges = spark.createDataFrame(pairs, "src long, dst long")

    low, active = dict(start), None
    for _ in range(3):
        got = {}
        for s, d in pairs:
            on = {"out": lambda: s in active, "in": lambda: d in active,
                  "either": lambda: s in active or d in active,
                  "both": lambda: s in active and d in active}[direction]
            if (active is None or on()) and low[s] < low[d]:
                got[d] = min(got.get(d, 99), low[s])
        if not got:
            break
        low.update({v: min(low[v], m) for v, m in got.items()})
        active = set(got)

    result = pregel(
        Graph(vertices, edges),
        F.lit(99).cast("long"),
        lambda message: {"low": F.least(F.col("low"), message)},
        merge=F.min,
        to_dst=F.when(F.col("src_low") < F.col("dst_low"), F.col("src_low")),
        max_rounds=3,
        allow_unfinished=True,
        direction=direction,
        broadcast_bytes=limit,
    )
    assert rows(result.vertices) == sorted(low.items())


def test_pregel_rejects_an_unknown_direction(cyclic_graph):
    with pytest.raises(ValueError, match="direction"):
        pregel(cyclic_graph, F.lit(0), lambda m: {}, merge=F.sum, max_rounds=1, direction="up")


def test_dense_ids(spark):
    names = [f"n{i * 7919 % 1000:04d}" for i in range(1000)]
    frame = spark.createDataFrame([(n,) for n in names], "name string").repartition(7)
    found = {r["name"]: r["id"] for r in dense_ids(frame, "name").collect()}
    assert found == {n: i for i, n in enumerate(sorted(names))}
    assert dense_ids(frame.where("false"), "name").count() == 0


def test_edges_with_ids(spark):
    edges = spark.createDataFrame([("b", "a", 2), ("a", "c", 3)], "src string, dst string, weight long")
    ids = vertex_ids(edges)
    assert rows(ids) == [(0, "a"), (1, "b"), (2, "c")]
    assert rows(edges_with_ids(edges, ids)) == [(0, 2, 3), (1, 0, 2)]
    some = ids.where("name <> 'c'")
    assert rows(edges_with_ids(edges, some)) == [(0, 0, 3), (1, 0, 2)]
    assert rows(edges_with_ids(edges, some, missing_id=None)) == [(0, None, 3), (1, 0, 2)]
    assert rows(edges_with_ids(edges, ids, broadcast_bytes=0)) == [(0, 2, 3), (1, 0, 2)]


def test_corpus_graph(spark):
    edges = spark.createDataFrame([("A", "电", 2)], "src string, dst string, weight long")
    graph = corpus_graph(edges)
    assert rows(graph.vertices) == [(11900135, "电"), (65, "A")]
    assert rows(graph.edges) == [(65, 11900135, 2)]


def test_lookup_join_beyond_the_bound(spark):
    """A key with a third of all rows, NULL keys and keys without a match."""
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0)
        .when(F.col("id") % 3 == 1, F.col("id"))
        .when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise(-1)
        .alias("k"),
        "id",
    )
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert rows(lookup_join(left, right, "k", broadcast_bytes=0)) == rows(left.join(right, "k", "left"))


def test_size_bound_counts_strings_and_refuses_arrays(spark):
    short = spark.createDataFrame([("a",)], "k string")
    long = spark.createDataFrame([("a" * 5000,)], "k string")
    assert lookup_module.estimated_bytes(long) - lookup_module.estimated_bytes(short) == 4999
    assert not lookup_module.fits_broadcast(long, 4000)
    assert lookup_module.fits_broadcast(short, 4000)
    with pytest.raises(TypeError, match="array"):
        lookup_module.estimated_bytes(spark.range(1).select(F.array("id").alias("a")))


def test_places_without_edges(spark):
    rng = random.Random(8)
    places = [None, -65, -64, -1, 0, 1, 63, 64, 1 << 40, (1 << 63) - 1, -(1 << 63)]
    paths = [None, 1, 2]
    kind = "struct<path:bigint,pos:bigint>"
    for _ in range(3):
        ids = [(rng.choice(paths), rng.choice(places)) for _ in range(40)] + [None]
        ends = [((rng.choice(paths), rng.choice(places)), (rng.choice(paths), rng.choice(places))) for _ in range(12)]
        vertices = spark.createDataFrame([(i, f"n{n}") for n, i in enumerate(ids)], f"id {kind}, name string").repartition(3)
        graph = Graph(vertices, spark.createDataFrame(ends, f"src {kind}, dst {kind}").repartition(2))
        for found, taken in ((graph.sources(), {d for _, d in ends}), (graph.sinks(), {s for s, _ in ends})):
            expected = sorted(f"n{n}" for n, i in enumerate(ids) if i not in taken)
            assert found.columns == ["id", "name"]
            assert sorted(r["name"] for r in found.collect()) == expected
            assert all(ids[int(r["name"][1:])] == (r["id"] and tuple(r["id"])) for r in found.collect())


def test_characters_stay_where_their_text_lies(spark, comments, monkeypatch):
    module, plans = importlib.import_module("glyphgraph.operators.graph"), []

    def seen(frame, name):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return frame

    monkeypatch.setattr(module, "materialize", seen)
    corpus = spark.createDataFrame([("a", "b", 3)], "src string, dst string, weight long")
    graph = comment_graph(comments("ab", "", None, "x" * 200), corpus)
    graph.sources(), graph.sinks()
    for plan in plans:
        # what comes after are the ids that hold a NULL
        named = plan.split("SortMergeJoin")[0]
        assert "ShuffledHashJoin" in named
        assert named.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in named
