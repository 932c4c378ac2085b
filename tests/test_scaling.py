"""Operators that spread one key, one path or one order over many tasks, and the tables they write."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from glyphgraph.operators import (
    ConstantTable,
    Graph,
    Tables,
    concat_sorted,
    deep_slice,
    materialize,
    merge_in_order,
    path_positions,
    pregel,
    running_totals,
    shared_dir,
)
from glyphgraph.operators import lookup as lookup_module
from glyphgraph.plans.comments import comment_slice, numbered_vertices
from glyphgraph.plans.segmentation import glue_labels, glue_paths


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def tables_on_disk(spark):
    folder = shared_dir(spark).removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


@pytest.mark.parametrize("fan_bits", [1, 2, 10])
def test_pieces_of_a_key_are_merged_in_order(spark, fan_bits):
    rng = random.Random(1)
    pieces = [(key, place, f"{key}{place} ") for key in "abc" for place in rng.sample(range(-50, 3000), 700)]
    pieces += [("d", 5, "one"), (None, 1, "x"), (None, 0, "y")]
    frame = spark.createDataFrame(rng.sample(pieces, len(pieces)), "key string, place long, text string").repartition(5)
    found = merge_in_order(frame, ["key"], "place", lambda p: {"text": F.array_join(p["text"], "")}, fan_bits=fan_bits)
    expected = {k: "".join(t for key, _, t in sorted(pieces, key=lambda r: r[1]) if key == k) for k, _, _ in pieces}
    assert dict(map(tuple, found.collect())) == expected


@pytest.mark.parametrize("fan_bits", [1, 10])
def test_strings_of_a_hub_are_joined_in_order(spark, fan_bits):
    rng = random.Random(2)
    strings = [(1, f"m{rng.randrange(500)}") for _ in range(900)] + [(2, "b"), (2, "a"), (2, "b"), (3, "")]
    frame = spark.createDataFrame(strings, "id long, msg string").repartition(4)
    found = dict(map(tuple, concat_sorted(frame, "id", "msg", "::", fan_bits=fan_bits).collect()))
    assert found == {k: "::".join(sorted(m for key, m in strings if key == k)) for k in (1, 2, 3)}


def test_a_hub_is_not_gathered_in_one_task(spark):
    strings = spark.range(50_000).select(F.lit(1).alias("id"), F.col("id").cast("string").alias("msg"))
    merged = concat_sorted(strings, "id", "msg", ",")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    groups = [line for line in plan.splitlines() if "collect_list" in line and "partial" not in line]
    keys = [re.search(r"keys=\[(.*?)\], functions", line).group(1).count("#") for line in groups]
    # the rows themselves meet in stretches only; what meets by the hub alone are the stretches of stretches
    assert keys == [1, 2, 2]
    assert merged.first()["msg"] == ",".join(sorted(str(i) for i in range(50_000)))


def test_running_totals(spark):
    rng = random.Random(3)
    values = [(i, rng.randrange(10)) for i in rng.sample(range(10_000), 500)]
    frame = spark.createDataFrame(values, "id long, n long").repartition(7)
    expected, total = [], 0
    for i, n in sorted(values):
        expected.append((i, n, total))
        total += n
    assert sorted(map(tuple, running_totals(frame, "id", "n").collect())) == expected
    assert running_totals(frame.where("false"), "id", "n").count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 28])
def test_vertex_numbers_neither_collide_nor_leave_gaps(spark, comments, limit):
    texts = ["abc", "", None, "é😀", "x" * 70_000, "y"]
    frame = comments(*texts).repartition(3)
    found = numbered_vertices(frame, broadcast_bytes=limit).orderBy("id").collect()
    expected = [(i, p, c) for i, t in enumerate(texts, 1) if t is not None for p, c in enumerate(list(t) or [""])]
    assert [tuple(r) for r in found] == [(n, *e) for n, e in enumerate(expected)]


@pytest.mark.parametrize(("skip", "limit"), [(0, 3), (4, 5), (7, 1), (58, 10), (60, 5), (200, 5), (3, 0)])
def test_deep_slices(spark, skip, limit):
    rng = random.Random(4)
    values = [rng.choice([None, *range(12)]) for _ in range(60)]
    frame = spark.createDataFrame(list(zip(values, range(60), strict=True)), "k long, n long").repartition(5)
    found = deep_slice(frame, "k", skip, limit).collect()
    ordered = sorted(values, key=lambda v: (v is not None, v or 0))
    assert [r["k"] for r in found] == ordered[skip : skip + limit]
    # each row at most once
    assert len({r["n"] for r in found}) == len(found)


def test_a_slice_is_the_same_however_it_is_found(spark):
    frame = spark.range(0, 3000, 3).selectExpr("id as comment_id", "string(id) as content").repartition(4)
    assert rows(comment_slice(frame, skip=70, limit=9)) == rows(comment_slice(frame, skip=70, limit=9, deep=0))


def path_graph(spark, lengths):
    names = [[f"{k}.{i * 7 % n}" for i in range(n)] for k, n in enumerate(lengths)]
    vertices = [(name,) for path in names for name in path]
    edges = [(a, b) for path in names for a, b in zip(path, path[1:], strict=False)]
    random.Random(5).shuffle(vertices)
    frames = spark.createDataFrame(vertices, "id string"), spark.createDataFrame(edges, "src string, dst string")
    return names, *(f.repartition(3) for f in frames)


def test_positions_by_pointer_doubling(spark):
    names, vertices, edges = path_graph(spark, [1, 2, 3, 5, 64, 65, 200])
    found = {r["id"]: (r["path"], r["pos"]) for r in path_positions(vertices, edges).collect()}
    assert found == {name: (path[0], i) for path in names for i, name in enumerate(path)}


def test_what_is_no_path_is_an_error(spark):
    vertices = spark.createDataFrame([(i,) for i in range(6)], "id long")
    for edges in ([(0, 1), (0, 2)], [(0, 2), (1, 2)], [(0, 1), (1, 0)], [(5, 0), (1, 2), (2, 3), (3, 1)]):
        with pytest.raises(ValueError, match="cycle|at most one"):
            path_positions(vertices, spark.createDataFrame(edges, "src long, dst long")).collect()


def glued(names, labels):
    """A text by the rules, from the start on."""
    text = names[0]
    if text == "" and len(names) > 1:
        return names[-1]
    for name, label in zip(names[1:], labels[1:], strict=True):
        piece = {"E": name + " ", "S": name + " ", "B": " " + name, "I": name, "M": name}.get(label)
        text = name if piece is None else text + piece
    return text


def test_given_labels_glue_over_many_stretches(spark):
    rng = random.Random(6)
    paths = {}
    for k in range(40):
        n = rng.choice([1, 2, 3, 40, 1024, 1025, 3000])
        kinds = "EBIMS" if k % 2 else "EBIMSUA"
        paths[k] = ([rng.choice(["a", "b", "", "é", " "]) for _ in range(n)], [rng.choice(kinds) for _ in range(n)])
    table = [(k, p * 3 + k, name, label) for k, path in paths.items() for p, (name, label) in enumerate(zip(*path, strict=True))]
    frame = spark.createDataFrame(rng.sample(table, len(table)), "path long, pos long, name string, label string").repartition(6)
    assert dict(map(tuple, glue_labels(frame).collect())) == {k: glued(*path) for k, path in paths.items()}


def test_paths_without_positions_are_glued(spark):
    names, vertices, edges = path_graph(spark, [1, 4, 30])
    labelled = vertices.select("id", F.substring_index("id", ".", -1).alias("name"), F.lit("E").alias("label"))
    found = dict(map(tuple, glue_paths(Graph(labelled, edges)).collect()))
    assert found == {p[0]: "".join(n.split(".")[1] + (" " if i else "") for i, n in enumerate(p)) for p in names}


def test_a_name_holds_one_table_at_a_time(spark):
    before, known = tables_on_disk(spark), {t.name for t in spark.catalog.listTables()}
    with Tables(spark) as tables:
        frame = tables.write(spark.range(10), "numbers")
        for _ in range(5):
            frame = tables.write(frame.selectExpr("id + 1 as id"), "numbers")
            assert len(tables_on_disk(spark) - before) == 1
        bucketed = tables.write_bucketed(frame, "bucketed", 3, "id")
        assert rows(bucketed) == rows(frame) == [(i,) for i in range(5, 15)]
        tables.keep("numbers")
    assert len(tables_on_disk(spark) - before) == 1
    assert frame.count() == 10
    assert {t.name for t in spark.catalog.listTables()} == known


@pytest.mark.parametrize("limit", [lookup_module.BROADCAST_BYTES, 0])
def test_a_vertex_program_of_many_rounds_keeps_few_tables(spark, limit):
    vertices = spark.range(12).selectExpr("id", "id as low")
    edges = spark.range(11).selectExpr("id as src", "id + 1 as dst")
    before, most = tables_on_disk(spark), []

    def program(message):
        most.append(len(tables_on_disk(spark) - before))
        return {"low": F.least(F.col("low"), message)}

    found = pregel(
        Graph(vertices, edges),
        F.lit(None).cast("long"),
        program,
        merge=F.min,
        to_dst=F.when(F.col("src_low") < F.col("dst_low"), F.col("src_low")),
        direction="either",
        broadcast_bytes=limit,
    )
    assert rows(found.vertices) == [(i, 0) for i in range(12)]
    assert len(most) == 12 and max(most) <= 8
    # the result's own: the vertices and what changed since they were written
    assert len(tables_on_disk(spark) - before) <= 2


def test_a_hot_source_is_spread_over_places(spark):
    vertices = spark.range(400).selectExpr("id", "id as low")
    edges = spark.range(4000).selectExpr("case when id % 3 = 0 then 7 else id % 400 end as src", "(id * 13 + 1) % 400 as dst")
    import importlib

    module = importlib.import_module("glyphgraph.operators.pregel")
    with Tables(spark) as tables:
        placed = module._Edges(tables, edges, placed=True)
        sizes = [r["count"] for r in placed.frame.groupBy("place").count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 4000 / 3


@pytest.mark.parametrize("n", [0, 1, 2, 17, 3000])
def test_a_constant_table_gives_the_value_of_every_key(spark, n):
    rng = random.Random(n)
    known = {rng.randrange(-(1 << 60), 1 << 60): rng.randrange(1 << 50) for _ in range(n)}
    frame = spark.createDataFrame(list(known.items()), "k long, v long")
    table = ConstantTable.of(frame, "k", "v")
    asked = [*known, *(rng.randrange(1 << 60) for _ in range(50)), None, 0]
    found = spark.createDataFrame([(asked,)], "items array<long>").select(table.values_of(F.col("items"), -1)).first()[0]
    assert found == [known.get(k, -1) for k in asked]


def test_a_big_table_is_no_constant(spark):
    frame = spark.range(20).selectExpr("id as k", "id as v")
    assert ConstantTable.of(frame, "k", "v", most_rows=19) is None
    assert ConstantTable.of(frame, "k", "v", most_rows=20) is not None


def test_rows_that_lie_one_after_the_other_move_as_one(spark, monkeypatch):
    """Paths in order, out of order, with gaps, restarts, NULLs and places that come twice."""
    from glyphgraph.plans import segmentation

    rng, table, written = random.Random(9), [], {}

    def seen(frame, name):
        written[name] = materialize(frame, name)
        return written[name]

    monkeypatch.setattr(segmentation, "materialize", seen)
    for k in range(30):
        places = sorted(rng.sample(range(-3, 60), 40)) if k % 3 else list(range(700))
        path = [((k, "p"), p, rng.choice(["a", "é", "", " ", "😀"]), rng.choice("EBIMSU" if k % 2 else "EBI")) for p in places]
        table += rng.sample(path, len(path)) if k % 5 == 4 else path
    kind = "path struct<k:bigint,s:string>, pos long, name string, label string"
    frame = spark.createDataFrame(table, kind).coalesce(1)
    expected = {}
    for path, _, name, label in sorted(table, key=lambda r: (r[0], r[1])):
        expected.setdefault(path, ([], []))
        expected[path][0].append(name)
        expected[path][1].append(label)
    found = {tuple(r["path"]): r["segmented"] for r in glue_labels(frame).collect()}
    assert found == {path: glued(*row) for path, row in expected.items()}
    assert written["label-runs"].count() < len(table) / 2
    # places that come twice: all rows in the order of place and text
    twice = [(k, p, c, "I") for k in (None, 1) for text in ("xyz", "abcd") for p, c in enumerate(text)] + [(2, 0, "q", "I")]
    frame = spark.createDataFrame(twice, "path long, pos long, name string, label string").coalesce(1)
    assert dict(map(tuple, glue_labels(frame).collect())) == {None: "axbyczd", 1: "axbyczd", 2: "q"}


def test_given_labels_go_to_the_tasks_as_they_are(spark, monkeypatch):
    """A character's row is its path, place, name and label; Spark adds up no batch of them after each row."""
    from glyphgraph.plans import segmentation

    setting, seen = "spark.sql.execution.arrow.maxBytesPerBatch", {}
    before = spark.conf.get(setting)

    def written(frame, name):
        plan = frame._jdf.queryExecution().optimizedPlan().toString().lower()
        seen[name] = spark.conf.get(setting), "concat" in plan or "case when" in plan
        return materialize(frame, name)

    monkeypatch.setattr(segmentation, "materialize", written)
    labels = ["E", "S", "B", "I", "M", "U", "A", "", None]
    table = [(k, p, name, labels[(p + k) % 9]) for k in range(9) for p, name in enumerate(["a", "é", "", "😀😀", " ", None, "xyz"] * 3)]
    frame = spark.createDataFrame(table, "path long, pos long, name string, label string").coalesce(1)
    found = dict(map(tuple, glue_labels(frame).collect()))
    assert seen["label-runs"] == (str((1 << 31) - 1), False) and spark.conf.get(setting) == before
    # the same rows out of order are glued one by one
    mixed = random.Random(3).sample(table, len(table))
    alone = spark.createDataFrame(mixed, "path long, pos long, name string, label string").repartition(7)
    assert found == dict(map(tuple, glue_labels(alone).collect())) and len(found) == 9
