import random

import pytest
from pyspark.sql import functions as F

from glyphgraph.functions import END_RATIO_FRACTIONAL, END_RATIO_INTEGER, label_of
from glyphgraph.operators import Graph, all_characters
from glyphgraph.plans import gluing
from glyphgraph.plans.comments import comment_graph, path_ends, path_starts, weighted_edges
from glyphgraph.plans.segmentation import (
    glue_labels,
    label_characters,
    pregel_glue,
    pregel_labels,
    segment_texts,
)

GOLDEN = [
    ("不", "A", "不"),
    ("不错", "AE", "不错 "),
    ("非常好", "AEE", "非常 好 "),
    ("好好用", "AIE", "好好用 "),
    ("哈哈哈", "AIE", "哈哈哈 "),
    ("速度很快", "AEBE", "速度  很快 "),
    ("很好很好", "AEBE", "很好  很好 "),
    ("电脑真好用", "AEEBE", "电脑 真  好用 "),
    ("电脑很不错", "AEBBE", "电脑  很 不错 "),
    ("还不错，整体还比较划算", "ABEEBEEBEEE", "还 不错 ，  整体 还  比较 划 算 "),
    ("", "A", ""),
]


def labels(frame):
    rows = frame.orderBy("comment_id", "pos").collect()
    found = {}
    for r in rows:
        found[r["comment_id"]] = found.get(r["comment_id"], "") + r["label"]
    return found


def texts(frame):
    return dict(map(tuple, frame.select("comment_id", "segmented").collect()))


# What labels and texts have to be, from the rule of a label in whole numbers.


def by_rule(text, weight_of):
    chars = list(text) or [""]
    weights = [0, *(weight_of.get(a + b, 0) for a, b in zip(chars, chars[1:], strict=False)), 0]
    labels, pieces = "", []
    for p, (c, before, after) in enumerate(zip(chars, weights[:-1], weights[1:], strict=True)):
        ends = after == 0 or before >= 2 * after
        begins = after > 0 and 10 * before < 7 * after
        label = "A" if p == 0 else "B" if begins else "E" if ends else "I"
        labels += label
        pieces.append(" " * (label == "B") + c + " " * (label == "E"))
    return labels, "".join(pieces)


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(5)
    alphabet = "很好不错电脑， a"
    lengths = [1, 2, 3, 50, 51, 52, 53, 90, *[rng.randint(1, 70) for _ in range(40)]]
    return ["".join(rng.choice(alphabet) for _ in range(n)) for n in lengths]


@pytest.fixture(scope="module")
def random_corpus(spark):
    rng = random.Random(6)
    pairs = {a + b: rng.choice([1, 3, 7, 10, 20, 100]) for a in "很好不错电脑a" for b in "很好不错a"}
    rows = [(p[0], p[1], w) for p, w in pairs.items()]
    return pairs, spark.createDataFrame(rows, "src string, dst string, weight long").persist()


def test_golden_labels_and_texts(comments, sample_corpus):
    frame = comments(*[g[0] for g in GOLDEN])
    assert labels(label_characters(frame, sample_corpus)) == {i: g[1] for i, g in enumerate(GOLDEN, 1)}
    assert texts(segment_texts(frame, sample_corpus)) == {i: g[2] for i, g in enumerate(GOLDEN, 1)}


def test_golden_weights(comments, sample_corpus):
    rows = weighted_edges(comments("速度很快，"), sample_corpus).orderBy("pos").collect()
    assert [r["weight"] for r in rows] == [122445, 39742, 84465, 0]
    assert [r["src_name"] + r["dst_name"] for r in rows] == ["速度", "度很", "很快", "快，"]


def test_labels_and_texts_follow_the_rule(comments, random_texts, random_corpus):
    weights, corpus = random_corpus
    frame = comments(*random_texts)
    expected = {i: by_rule(t, weights) for i, t in enumerate(random_texts, 1)}
    assert labels(label_characters(frame, corpus)) == {i: e[0] for i, e in expected.items()}
    assert texts(segment_texts(frame, corpus)) == {i: e[1] for i, e in expected.items()}


def test_pregel_gives_the_same_labels(comments, random_texts, random_corpus):
    _, corpus = random_corpus
    frame = comments(*random_texts[:12]).repartition(3)
    rows = pregel_labels(frame, corpus).vertices.select("id.comment_id", "id.pos", "label")
    assert labels(rows) == labels(label_characters(frame, corpus))


def test_pregel_gives_the_same_texts(comments, random_texts, random_corpus):
    _, corpus = random_corpus
    frame = comments(*[text[:5] for text in random_texts[:8]]).repartition(3)
    graph = pregel_labels(frame, corpus)
    glued = pregel_glue(graph.map_vertices(name=F.col("name"), label=F.col("label")))
    ends = path_ends(frame).select(F.struct("comment_id", "pos").alias("id"))
    segmented = glued.members(ends).select("id.comment_id", F.col("text").alias("segmented"))
    assert texts(segmented) == texts(segment_texts(frame, corpus))


def test_pregel_without_broadcast(comments, random_texts, random_corpus):
    _, corpus = random_corpus
    frame = comments(*random_texts[:6])
    graph = pregel_labels(frame, corpus, broadcast_bytes=0)
    rows = graph.vertices.select("id.comment_id", "id.pos", "label")
    assert labels(rows) == labels(label_characters(frame, corpus))


def test_corpus_beyond_the_broadcast_bound(comments, random_texts, random_corpus):
    _, corpus = random_corpus
    frame = comments(*random_texts)
    big = {"broadcast_bytes": 0}
    assert labels(label_characters(frame, corpus, **big)) == labels(label_characters(frame, corpus))
    assert texts(segment_texts(frame, corpus, **big)) == texts(segment_texts(frame, corpus))


@pytest.mark.parametrize("size", [1, 7, 64])
def test_texts_cut_into_stretches(comments, random_texts, random_corpus, size):
    _, corpus = random_corpus
    frame = comments(*random_texts)
    cut = segment_texts(frame, corpus, unit_size=size)
    assert texts(cut) == texts(segment_texts(frame, corpus))


@pytest.mark.parametrize("text", ["😀a" * 40000, "aaa😀" * 20000], ids=["often", "sometimes"])
def test_long_texts_whose_characters_change_in_width(spark, comments, text):
    empty = spark.createDataFrame([], "src string, dst string, weight long")
    assert texts(segment_texts(comments(text), empty)) == {1: text[0] + "".join(c + " " for c in text[1:])}
    assert all_characters(comments(text)).count() == len(text)


def test_null_text_gives_no_rows(comments, sample_corpus):
    frame = comments(None, "不错")
    assert labels(label_characters(frame, sample_corpus)) == {2: "AE"}
    assert texts(segment_texts(frame, sample_corpus)) == {2: "不错 "}


@pytest.mark.parametrize("rows", [[(1, "不错"), (1, "很好")], [(None, "不错")], [(1, "不错"), (1, "很好很好")]])
def test_comment_ids_must_be_unique(comments, sample_corpus, rows):
    with pytest.raises(Exception, match="unique"):
        segment_texts(comments(*rows), sample_corpus, unit_size=3).collect()


def test_pair_stored_twice_is_added_up(spark, comments):
    corpus = spark.createDataFrame([("a", "b", 5), ("a", "b", 7)], "src string, dst string, weight long")
    assert [r["weight"] for r in weighted_edges(comments("ab"), corpus).collect()] == [12]


def test_longer_names_never_match(spark, comments):
    corpus = spark.createDataFrame([("ab", "c", 5), ("", "a", 7)], "src string, dst string, weight long")
    assert [r["weight"] for r in weighted_edges(comments("abc"), corpus).collect()] == [0, 0]


@pytest.mark.parametrize(
    ("w_in", "w_out", "whole", "fractional"),
    [(7, 10, "I", "I"), (6, 10, "B", "B"), (19, 10, "I", "E"), (20, 10, "E", "E"), (11, 10, "I", "I"), (5, 0, "E", "E")],
)
def test_label_borders(spark, w_in, w_out, whole, fractional):
    one = [F.lit(1), F.lit(w_in).cast("long"), F.lit(w_out).cast("long")]
    row = spark.range(1).select(
        label_of(*one).alias("whole"), label_of(*one, end_ratio=END_RATIO_FRACTIONAL).alias("fractional")
    ).first()
    assert tuple(row) == (whole, fractional)


@pytest.mark.parametrize("weights", [(7, 10), (2000000000, 2857142857), (2147483647, 3067833781)])
def test_label_rule_is_exact_for_big_weights(spark, weights):
    w_in, w_out = weights
    row = spark.range(1).select(
        label_of(F.lit(1), F.lit(w_in).cast("long"), F.lit(w_out).cast("long")).alias("x")
    ).first()
    assert row["x"] == ("B" if 10 * w_in < 7 * w_out else "I")


PATHS = [
    (["天", "气", "", "很", "好", "我", "们", "去", "公", "园"], "SBMEBESBEB", "天 气很  好我 们  去公  园"),
    (["今", "天", "", "下", "雨", "了"], "SSMBEI", "今天  下雨 了"),
    (["a", "b", "c", "d"], "AEUE", "cd "),
    (["a", "b", "c"], "AEU", "c"),
    (["a"], "E", "a"),
    (["", "b", "c"], "AEE", "c"),
    (["", "b"], "AE", "b"),
]


def labelled_paths(spark):
    rows = [
        (k, p, name, label)
        for k, (names, marks, _) in enumerate(PATHS)
        for p, (name, label) in enumerate(zip(names, marks, strict=True))
    ]
    return spark.createDataFrame(rows, "path long, pos long, name string, label string")


def test_glue_given_labels(spark):
    found = dict(map(tuple, glue_labels(labelled_paths(spark)).collect()))
    assert found == {k: p[2] for k, p in enumerate(PATHS)}


def test_glue_given_labels_by_vertex_program(spark):
    rows = labelled_paths(spark)
    number = F.col("path") * 100 + F.col("pos")
    vertices = rows.select(number.alias("id"), "name", "label")
    edges = rows.where("pos > 0").select((number - 1).alias("src"), number.alias("dst"))
    glued = pregel_glue(Graph(vertices, edges))
    found = {r["id"] // 100: r["text"] for r in glued.members(Graph(vertices, edges).sinks()).collect()}
    assert found == {k: p[2] for k, p in enumerate(PATHS)}


@pytest.mark.parametrize("letters", [gluing._DENSE, 0])
@pytest.mark.parametrize("size", [None, 1, 3])
def test_stretches_glued_as_arrays_are_those_glued_as_columns(spark, comments, monkeypatch, letters, size):
    monkeypatch.setattr(gluing, "_DENSE", letters)
    monkeypatch.setattr(gluing, "_CHUNK_BYTES", 40)
    rng = random.Random(10)
    alphabet = "ab é很😀。\n"
    rows = [(a, b, rng.choice([1, 6, 7, 10, 14, 20, 40])) for a in alphabet for b in alphabet if rng.random() < 0.7]
    corpus = spark.createDataFrame(rows, "src string, dst string, weight long")
    frame = comments("", None, "a", *["".join(rng.choice(alphabet + "\U0010ffffz") for _ in range(rng.randrange(60))) for _ in range(60)])
    for ratio in (END_RATIO_INTEGER, END_RATIO_FRACTIONAL):
        found = segment_texts(frame, corpus, end_ratio=ratio, unit_size=size)
        assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
        as_columns = segment_texts(frame, corpus, end_ratio=lambda i, o: ratio(i, o), unit_size=size)  # noqa: B023
        assert texts(found) == texts(as_columns)
