import pytest
from pyspark.sql import functions as F

from glyphgraph.functions import char_code, is_kept, pair_key, vertex_number
from glyphgraph.operators import adjacent_pairs, all_characters
from glyphgraph.operators.characters import text_units, unit_characters
from glyphgraph.plans.comments import char_positions, comment_slice, path_ends, path_starts
from glyphgraph.plans.corpus import bigram_edges, characters_with_codes, kept_pairs, top_edges


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "code"),
    [
        ("数", 11572710),
        ("啰", 11572709),
        ("电", 11900135),
        ("A", 65),
        ("é", 43459),
        ("😀", 2157486064),
        ("", 0),
        ("abcdefgh", int.from_bytes(b"abcdefgh", "little")),
    ],
)
def test_char_code(spark, name, code):
    assert one(spark, char_code(F.lit(name))) == code


def test_char_code_of_eight_high_bytes_is_signed(spark):
    assert one(spark, char_code(F.lit("éééé"))) == int.from_bytes("éééé".encode(), "little", signed=True)


def test_char_code_limits(spark):
    assert one(spark, char_code(F.lit(None).cast("string"))) is None
    with pytest.raises(Exception, match="more than 8"):
        one(spark, char_code(F.lit("abcdefghi")))


def test_is_kept(spark):
    dropped = "。，！？：；～（） ~?;.&\0'()[],\\$@/0123456789"
    kept = '!:-"#%*+=_<>{}|^`、“”…\t\n０９aA中😀'
    rows = spark.createDataFrame([(c,) for c in dropped + kept], "c string")
    found = {r["c"]: r["k"] for r in rows.select("c", is_kept(F.col("c")).alias("k")).collect()}
    assert found == {c: c in kept for c in dropped + kept}


def test_pair_key_tells_pairs_apart(spark):
    names = ["a", "b", "中", "é", "😀", "\U0010ffff", "\0"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    assert pairs.select(pair_key(F.col("a"), F.col("b"))).distinct().count() == len(names) ** 2
    assert one(spark, pair_key(F.lit("a"), F.lit(None).cast("string"))) is None


def test_vertex_number(spark):
    assert one(spark, vertex_number(F.lit(7).cast("long"), F.lit(12))) == 70012


def test_kept_pairs(comments):
    rows = kept_pairs(comments("不错，很好5A!a")).orderBy("pos").collect()
    assert [(r["pos"], r["src"] + r["dst"]) for r in rows] == [(0, "不错"), (3, "很好"), (6, "A!"), (7, "!a")]


def test_characters_of_odd_texts(comments):
    rows = char_positions(comments("", None, "x", "a😀b")).collect()
    found = sorted((r["comment_id"], r["pos"], r["ch"]) for r in rows)
    assert found == [(1, 0, ""), (3, 0, "x"), (4, 0, "a"), (4, 1, "😀"), (4, 2, "b")]


def test_neighbours(comments):
    rows = all_characters(comments("abc")).orderBy("pos").collect()
    assert [(r["prev"], r["ch"], r["next"]) for r in rows] == [
        (None, "a", "b"),
        ("a", "b", "c"),
        ("b", "c", None),
    ]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 100])
def test_units_give_the_same_characters(comments, size):
    frame = comments("", "a", "ab\ncd😀é中\n\nf", "一二三四五六")
    cut = unit_characters(text_units(frame, size), "comment_id", unit_characters=size)
    whole = all_characters(frame)
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))


def test_starts_and_ends(comments):
    frame = comments("abc", "", None, "x")
    assert sorted(map(tuple, path_starts(frame).collect())) == [(1, 0), (2, 0), (4, 0)]
    assert sorted(map(tuple, path_ends(frame).collect())) == [(1, 2), (2, 0), (4, 0)]


def test_bigram_edges_count_every_kept_pair(comments):
    frame = comments("abab", "ab a", "1a", "")
    found = {(r["src"] + r["dst"]): r["weight"] for r in bigram_edges(frame).collect()}
    assert found == {"ab": 3, "ba": 1}
    assert sum(found.values()) == kept_pairs(frame).count()
    assert adjacent_pairs(frame).count() == 3 + 3 + 1


def test_top_edges_breaks_ties_by_name(comments):
    edges = bigram_edges(comments("ba", "ca", "cb", "ab", "ab"))
    assert [r["src"] + r["dst"] for r in top_edges(edges, 3).collect()] == ["ab", "ba", "ca"]


def test_characters_with_codes(comments):
    found = dict(map(tuple, characters_with_codes(comments("电A", "A")).collect()))
    assert found == {"电": 11900135, "A": 65}


def test_comment_slice(spark, comments):
    frame = comments(*[(i, str(i)) for i in range(500, -1, -1)])
    ids = [r["comment_id"] for r in comment_slice(frame).collect()]
    assert ids == list(range(322, 372))
    assert comment_slice(frame, skip=600).count() == 0


@pytest.mark.parametrize("text", ["😀a" * 40000, "aaa😀" * 20000])
def test_long_texts_of_mixed_width(comments, text):
    units = text_units(comments(text)).orderBy("unit").collect()
    assert "".join(u["body"] for u in units) == text
    assert all(len(u["body"]) == 65536 for u in units[:-1])
