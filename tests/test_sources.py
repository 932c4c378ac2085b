import json

import pytest
from pyspark.sql import functions as F

from glyphgraph import sources
from glyphgraph.operators import Graph, materialize, shared_dir
from glyphgraph.sources import schemas
from glyphgraph.plans import comments as texts
from glyphgraph.plans import results, segmentation


# Fixed values in this file: the stored field names sourceName, desName, weight, vertexId, wordName, sourceId and
# desId, the id field of an export, and the marks of result lines.


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def write_lines(path, records):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in records), encoding="utf-8")
    return str(path)


def test_exported_edges_as_json(spark, tmp_path):
    path = write_lines(
        tmp_path / "edges.json",
        [
            {"_id": {"$oid": "0"}, "sourceName": "不", "desName": "错", "weight": 362779},
            {"_id": {"$oid": "1"}, "sourceName": "电", "desName": "脑", "weight": 238688},
        ],
    )
    found = sources.read_bigram_edges(spark, path, format="json")
    assert found.dtypes == [("src", "string"), ("dst", "string"), ("weight", "bigint")]
    assert rows(found) == [("不", "错", 362779), ("电", "脑", 238688)]


def test_numbers_stored_as_strings(spark, tmp_path):
    vertices = write_lines(tmp_path / "v.json", [{"vertexId": "1", "wordName": "电"}])
    edges = write_lines(tmp_path / "e.json", [{"sourceId": "1", "desId": "2", "weight": "3"}])
    assert rows(sources.read_vertices(spark, vertices, format="json")) == [(1, "电")]
    assert rows(sources.read_id_edges(spark, edges, format="json")) == [(1, 2, 3)]


def test_comments_from_json_and_table(spark, tmp_path):
    path = write_lines(tmp_path / "c.json", [{"comment_id": 1, "content": "好 '用'"}, {"comment_id": 2}])
    found = sources.read_comments(spark, path, format="json")
    assert rows(found) == [(1, "好 '用'"), (2, None)]
    found.write.mode("overwrite").saveAsTable("comments_sorted")
    assert rows(sources.read_comments(spark, "comments_sorted", format="table")) == rows(found)


def test_names_with_quotes_survive(spark, tmp_path):
    edges = spark.createDataFrame([("'", '"', 3)], "src string, dst string, weight long")
    for kind in ("parquet", "json"):
        path = str(tmp_path / kind)
        sources.save_bigram_edges(edges, path, format=kind)
        assert rows(sources.read_bigram_edges(spark, path, format=kind)) == [("'", '"', 3)]


def test_overwrite_and_append(spark, tmp_path):
    path = str(tmp_path / "v")
    vertices = spark.createDataFrame([(1, "a")], "id long, name string")
    sources.save_vertices(vertices, path)
    sources.save_vertices(vertices, path)
    assert rows(sources.read_vertices(spark, path)) == [(1, "a")]
    sources.save_vertices(vertices, path, mode="append")
    assert rows(sources.read_vertices(spark, path)) == [(1, "a"), (1, "a")]
    assert spark.read.parquet(path).columns == ["vertexId", "wordName"]


def test_save_as_catalog_table(spark):
    edges = spark.createDataFrame([(1, 2, 3)], "src long, dst long, weight long")
    sources.save_id_edges(edges, "id_edges", format="table")
    assert spark.table("id_edges").columns == ["sourceId", "desId", "weight"]
    assert rows(sources.read_id_edges(spark, "id_edges", format="table")) == [(1, 2, 3)]


def test_slice_condition_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(10).selectExpr("id as comment_id", "'x' as content", "'y' as other").write.parquet(path)
    plan = texts.comment_slice(sources.read_comments(spark, path))._jdf.queryExecution().toString()
    assert "GreaterThan(comment_id,1)" in plan
    assert "other" not in plan.split("== Physical Plan ==")[1]


def test_materialize_reads_what_it_wrote(spark):
    frame = materialize(spark.range(5).withColumn("r", F.rand()), "numbers")
    assert rows(frame) == rows(frame)
    assert shared_dir(spark).removeprefix("file:") in frame.inputFiles()[0]


def test_shared_dir_is_the_configured_one(spark):
    assert spark.conf.get("spark.checkpoint.dir") in shared_dir(spark)


def test_result_lines_and_text_file(spark, comments, sample_corpus, tmp_path):
    segmented = segmentation.segment_texts(comments("不错", "很 好"), sample_corpus)
    lines = results.result_lines(segmented).orderBy("comment_id", "line_no").collect()
    expected = ["【原始】不错", "【分词】不错 ", "", "【原始】很好", "【分词】很  好 ", ""]
    assert [r["value"] for r in lines] == expected

    path = str(tmp_path / "result")
    sources.save_result_text(results.result_blocks(segmented.coalesce(1).orderBy("comment_id")), path)
    assert [r["value"] for r in spark.read.text(path).collect()] == expected


def test_exports(comments, sample_corpus):
    frame = comments("不错")
    labelled = segmentation.label_characters(frame, sample_corpus)
    assert rows(results.export_nodes(labelled)) == [("1:0", "不A362779"), ("1:1", "错E0")]
    assert rows(results.export_nodes(labelled, with_weight=False)) == [("1:0", "不A"), ("1:1", "错E")]
    assert rows(results.export_nodes(labelled, with_label=False, with_weight=False))[0] == ("1:0", "不")
    edges = results.export_edges(texts.weighted_edges(frame, sample_corpus))
    assert rows(edges) == [("1:0->1:1", "1:0", "1:1", "362779", 0.1)]


def test_broken_json_lines_are_told_apart(spark, tmp_path):
    lines = [
        '{"_id":{"$oid":"0"},"sourceName":"不","desName":"错","weight":362779}',
        '{"sourceName":"a","desName":"b","weight":"12"}',
        "",
        '{"sourceName":"a","desName":',
        "no json",
        '{"sourceName":"a","weight":3}',
        '{"sourceName":"a","desName":"b","weight":"many"}',
        "[1, 2]",
        '{"sourceName":null,"desName":"b","weight":1}',
    ]
    path = tmp_path / "edges.json"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    good, rejected = sources.read_bigram_json(spark, str(path))
    assert good.dtypes == [("src", "string"), ("dst", "string"), ("weight", "bigint")]
    assert rows(good) == [("a", "b", 12), ("不", "错", 362779)]
    found = {r["line"]: r["reason"] for r in rejected.collect()}
    assert found[lines[3]] == found[lines[4]] == "no JSON object"
    assert found[lines[5]] == "desName is missing" and found[lines[8]] == "sourceName is missing"
    assert found[lines[6]] == "weight is no bigint"
    assert set(found) == set(lines[3:])


def saved_graph(spark):
    vertices = spark.createDataFrame([(0, "a"), (1, "'"), (2, None)], "id long, name string")
    return Graph(vertices, spark.createDataFrame([(0, 1, 5), (0, 1, 5), (2, 0, 7)], "src long, dst long, weight long"))


def test_a_saved_graph_comes_back(spark, tmp_path):
    graph = saved_graph(spark)
    for name, location in (("kept_graph", None), ("outer_graph", str(tmp_path / "g"))):
        for _ in range(2):
            sources.save_graph(graph, name, location=location)
        read = sources.read_graph(spark, name)
        assert rows(read.vertices) == rows(graph.vertices) and rows(read.edges) == rows(graph.edges)
        assert spark.table(f"{name}_vertices").columns == list(schemas.STORED_VERTICES)


def test_a_graph_that_changed_since_it_was_saved_is_refused(spark, tmp_path):
    graph = saved_graph(spark)
    sources.save_graph(graph, "g1", location=str(tmp_path / "g1"))
    other = spark.createDataFrame([(0, 1, 5), (0, 1, 6), (2, 0, 7)], "sourceId long, desId long, weight long")
    other.write.mode("overwrite").option("path", str(tmp_path / "g1/g1_edges")).saveAsTable("g1_edges")
    with pytest.raises(ValueError, match="does not hold the rows"):
        sources.read_graph(spark, "g1")
    assert sources.read_graph(spark, "g1", verify=False).edges.count() == 3
    other.withColumn("weight", F.col("weight").cast("int")).write.mode("overwrite").option(
        "path", str(tmp_path / "g1/g1_edges")
    ).saveAsTable("g1_edges")
    with pytest.raises(ValueError, match="fields"):
        sources.read_graph(spark, "g1", verify=False)
    spark.sql("DROP TABLE g1_manifest")
    with pytest.raises(ValueError, match="manifest"):
        sources.read_graph(spark, "g1")


def test_registered_sources_and_overrides(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([("1", "t", "s")], "doc_id string, text string, source string").write.parquet(path)
    registry = sources.SourceRegistry(spark)
    registry.add("docs_here", path, {"doc_id": "comment_id", "text": "content"})
    assert registry.columns("docs_here") == {"doc_id": "comment_id", "text": "content"}
    assert rows(registry.load("docs_here")) == [(1, "t")]
    assert rows(registry.load("docs_here", columns={"source": "content"})) == [(1, "s")]
    # registering again replaces
    registry.add("docs_here", path, {"doc_id": "comment_id"})
    with pytest.raises(ValueError, match="content"):
        registry.load("docs_here")
    spark.sql("CREATE DATABASE IF NOT EXISTS elsewhere")
    other = sources.SourceRegistry(spark, "elsewhere")
    other.add("docs_here", path, {"doc_id": "comment_id", "source": "content"})
    assert rows(registry.load("docs_here", database="elsewhere")) == [(1, "s")]
    assert rows(other.load("docs_here")) == [(1, "s")]
    spark.sql("DROP DATABASE elsewhere CASCADE")


def test_a_result_file_comes_back(spark, tmp_path):
    texts = ["a b", "", " ", "x\n\ny", "\n", "【原始】k", "k\n【分词】 l", "m\n\n【原始】n"[:3], "end\n\n", "é 😀"]
    frame = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts * 3)], "comment_id long, segmented string")
    target = str(tmp_path / "result")
    results.save_result_file(frame.repartition(5), target, part_blocks=4)
    read = results.read_result_file(spark, target)
    assert sorted(r["segmented"] for r in read.collect()) == sorted(texts * 3)
    assert all(r["original"] == r["segmented"].replace(" ", "") for r in read.collect())
    index = spark.read.parquet(f"{target}/index").orderBy("comment_id").collect()
    assert [tuple(r) for r in index] == [(i * 3, i // 4, i % 4) for i in range(30)]
    # parts one after the other are the whole file, in the order of the ids
    parts = sorted((tmp_path / "result/blocks").glob("part=*"), key=lambda p: int(p.name.split("=")[1]))
    whole = "".join(f.read_text(encoding="utf-8") for p in parts for f in sorted(p.glob("*.txt")))
    expected = [f"{results.ORIGINAL_MARK}{t.replace(' ', '')}\n{results.SEGMENTED_MARK}{t}\n\n" for t in texts * 3]
    assert len(parts) == 8 and whole == "".join(expected)
    assert results.file_lines(read).count() == 90


def test_a_result_file_that_lost_a_part_is_refused(spark, tmp_path):
    target = str(tmp_path / "result")
    frame = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "comment_id long, segmented string")
    results.save_result_file(frame, target, part_blocks=2)
    spark.createDataFrame([(9, 9, 0)], "comment_id long, part long, place long").write.mode("append").parquet(f"{target}/index")
    with pytest.raises(ValueError, match="index"):
        results.read_result_file(spark, target)


def test_a_part_of_a_result_file_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(results, "FILE_BLOCKS", 3)
    target = str(tmp_path / "result")
    frame = spark.createDataFrame([(i, f"t {i}\n") for i in range(23)], "comment_id long, segmented string")
    results.save_result_file(frame.repartition(4), target, part_blocks=10)
    parts = sorted((tmp_path / "result/blocks").glob("part=*"), key=lambda p: int(p.name.split("=")[1]))
    files = [f for p in parts for f in sorted(p.glob("*.txt"))]
    blocks = [f.read_text(encoding="utf-8").count(results.SEGMENTED_MARK) for f in files]
    assert blocks == [3, 3, 3, 1, 3, 3, 3, 1, 3]
    expected = [f"{results.ORIGINAL_MARK}t{i}\n\n{results.SEGMENTED_MARK}t {i}\n\n\n" for i in range(23)]
    assert "".join(f.read_text(encoding="utf-8") for f in files) == "".join(expected)
    read = results.read_result_file(spark, target)
    assert sorted(tuple(r) for r in read.collect()) == sorted((i // 10, f"t{i}\n", f"t {i}\n") for i in range(23))
