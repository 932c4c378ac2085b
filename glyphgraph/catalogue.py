"""The registered queries. Each takes (spark, folder of parquet tables) and gives a DataFrame.

`documents(doc_id, text)` plays the part of the comments. A query that needs the corpus counts it from
all documents and writes it to the shared folder first, as every later pass reads it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .operators import Graph, materialize, pregel
from .operators.storage import find_package, new_path
from .plans import comments as texts
from .plans import corpus as corpora
from .plans import results, segmentation

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    _QUERIES[build.__name__] = build
    return build


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# inputs


def _comments(spark: SparkSession, folder: str) -> DataFrame:
    find_package(spark)
    return sources.read_comments(
        spark, f"{folder}/documents.parquet", id_column="doc_id", text_column="text"
    )


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(corpora.counted_pairs(_comments(spark, folder)), "corpus")


def _corpus_graph(spark: SparkSession, folder: str) -> Graph:
    graph = corpora.corpus_graph(_corpus(spark, folder))
    return Graph(materialize(graph.vertices, "corpus-vertices"), graph.edges)


def _edges_with_ids(spark: SparkSession, folder: str) -> DataFrame:
    corpus = _corpus(spark, folder)
    return corpora.edges_with_ids(corpus, corpora.vertex_ids(corpus))


def _stored_vertices(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.col("id").alias("vertex_id"), "name")


def _stored_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("source_id"), F.col("dst").alias("des_id"), "weight")


# comments and characters


@_query
def scan_comments(spark, folder):
    return _comments(spark, folder)


@_query
def comment_slice(spark, folder):
    return texts.comment_slice(_comments(spark, folder))


@_query
def counted_slice(spark, folder):
    # the same slice by counting ids, as one that lies deep is found
    return texts.comment_slice(_comments(spark, folder), deep=0)


@_query
def scan_comments_table(spark, folder):
    path = f"{folder}/documents.parquet"
    registry = sources.SourceRegistry(spark)
    table = "documents_" + hashlib.sha256(path.encode()).hexdigest()[:16]
    registry.add(table, path, {"doc_id": "comment_id", "source": "content"})
    # the content is taken from another field than the source was registered with
    return registry.load(table, columns={"text": "content"})


@_query
def char_positions(spark, folder):
    return texts.char_positions(_comments(spark, folder))


@_query
def pair_filter(spark, folder):
    return corpora.kept_pairs(_comments(spark, folder))


@_query
def char_codes(spark, folder):
    return corpora.characters_with_codes(_comments(spark, folder))


@_query
def comment_edges(spark, folder):
    return texts.blank_edges(_comments(spark, folder))


# corpus


@_query
def bigram_edges(spark, folder):
    return corpora.heaviest_first(corpora.bigram_edges(_comments(spark, folder)))


@_query
def bigram_top_k(spark, folder):
    return corpora.top_edges(corpora.bigram_edges(_comments(spark, folder)), 300)


@_query
def bigram_edges_roundtrip(spark, folder):
    path = new_path(spark, "all-edges")
    sources.save_bigram_edges(corpora.bigram_edges(_comments(spark, folder)), path)
    return sources.read_bigram_edges(spark, path)


@_query
def bigram_edges_json(spark, folder):
    """An export with the ids of its store and two broken lines: the pairs, and why lines were rejected."""
    corpus = _corpus(spark, folder)
    stored = {"sourceName": "src", "desName": "dst", "weight": "weight"}
    line = F.struct(
        F.struct(F.sha2(F.concat("src", "dst"), 256).alias("$oid")).alias("_id"),
        *[F.col(name).alias(field) for field, name in stored.items()],
    )
    broken = spark.range(2).select(
        F.when(F.col("id") == 0, '{"sourceName":"a","desName":').otherwise('{"sourceName":"a","desName":"b","weight":"many"}').alias("value")
    )
    path = new_path(spark, "edges-json")
    corpus.select(F.to_json(line).alias("value")).unionByName(broken).write.text(path)
    good, rejected = sources.read_bigram_json(spark, path)
    return good.unionByName(rejected.select(F.col("reason")), allowMissingColumns=True)


@_query
def corpus_vertices(spark, folder):
    return corpora.corpus_graph(_corpus(spark, folder)).vertices


@_query
def corpus_edges(spark, folder):
    edges = corpora.bigram_edges(_comments(spark, folder))
    return corpora.corpus_graph(edges).edges


@_query
def vertex_ids(spark, folder):
    edges = corpora.bigram_edges(_comments(spark, folder))
    return _stored_vertices(corpora.vertex_ids(edges))


@_query
def edges_with_ids(spark, folder):
    return _stored_edges(_edges_with_ids(spark, folder))


@_query
def graph_vertices_roundtrip(spark, folder):
    path = new_path(spark, "vertices")
    sources.save_vertices(corpora.vertex_ids(_corpus(spark, folder)), path)
    return _stored_vertices(sources.read_vertices(spark, path))


@_query
def graph_edges_roundtrip(spark, folder):
    path = new_path(spark, "edges")
    sources.save_id_edges(_edges_with_ids(spark, folder), path)
    return _stored_edges(sources.read_id_edges(spark, path))


# graph operators


@_query
def graph_counts(spark, folder):
    corpus = _corpus(spark, folder)
    vertices = corpora.vertex_ids(corpus)
    graph = Graph.build(vertices, corpora.edges_with_ids(corpus, vertices))
    vertex, edge = F.lit(1).alias("vertex"), F.lit(1).alias("edge")
    no_vertex, no_edge = F.lit(0).alias("vertex"), F.lit(0).alias("edge")
    both = graph.vertices.select(vertex, no_edge).unionByName(graph.edges.select(no_vertex, edge))
    return both.agg(F.sum("vertex").alias("n_vertices"), F.sum("edge").alias("n_edges"))


@_query
def graph_from_store(spark, folder):
    corpus = _corpus(spark, folder)
    vertices = corpora.vertex_ids(corpus)
    saved = Graph(vertices, corpora.edges_with_ids(corpus, vertices))
    name = f"graph_{uuid.uuid4().hex}"
    sources.save_graph(saved, name, location=new_path(spark, "graph"))
    read = sources.read_graph(spark, name)
    graph = Graph.build(read.vertices, read.edges)
    vertex_count = graph.vertices.agg(F.count("*").alias("n_vertices"))
    weights = graph.triplets(ends=("src",)).where(F.col("src_name").isNotNull())
    edge_count = weights.agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"))
    # one row on either side
    return vertex_count.join(edge_count)


@_query
def graph_build(spark, folder):
    # the vertex table lacks the characters that nothing leads to; they come out without a name
    graph = _corpus_graph(spark, folder)
    return Graph.build(graph.members(graph.in_degrees()), graph.edges).vertices


@_query
def out_degrees(spark, folder):
    return corpora.corpus_graph(_corpus(spark, folder)).out_degrees()


@_query
def in_degrees(spark, folder):
    return corpora.corpus_graph(_corpus(spark, folder)).in_degrees()


@_query
def source_vertices(spark, folder):
    return _corpus_graph(spark, folder).sources()


@_query
def sink_vertices(spark, folder):
    return _corpus_graph(spark, folder).sinks()


@_query
def reverse_edges(spark, folder):
    return corpora.corpus_graph(_corpus(spark, folder)).reverse().edges


@_query
def triplets(spark, folder):
    return _corpus_graph(spark, folder).triplets()


@_query
def map_vertices(spark, folder):
    graph = _corpus_graph(spark, folder).map_vertices(
        name=F.col("name"), label=F.lit("A"), out_weight=F.lit(0).cast("long")
    )
    return graph.vertices


@_query
def map_edges(spark, folder):
    graph = corpora.corpus_graph(_corpus(spark, folder))
    return graph.map_edges(link_weight=F.col("weight")).edges


@_query
def join_vertices(spark, folder):
    graph = _corpus_graph(spark, folder).map_vertices(out_degree=F.lit(0).cast("long"))
    degrees = graph.out_degrees().withColumnRenamed("degree", "out_degree")
    return graph.join_vertices(degrees).vertices


@_query
def agg_messages_in(spark, folder):
    graph = corpora.corpus_graph(_corpus(spark, folder))
    return graph.aggregate_messages(F.sum("msg").alias("in_weight"), to_dst=F.col("weight"))


@_query
def agg_messages_out(spark, folder):
    graph = corpora.corpus_graph(_corpus(spark, folder))
    return graph.reverse().aggregate_messages(
        F.max("msg").alias("out_weight"), to_dst=F.col("weight")
    )


@_query
def agg_messages_names(spark, folder):
    graph = _corpus_graph(spark, folder)
    return graph.concat_messages("::", to_src=F.col("dst_name"), ends=("dst",), name="neighbours")


@_query
def pregel_components(spark, folder):
    """The smallest character that each is connected with by edges to heaviest successors, whatever their direction."""
    graph = _corpus_graph(spark, folder)
    heaviest = F.max_by("dst", F.struct("weight", -F.col("dst"))).alias("dst")
    followed = Graph(graph.vertices.select("id", F.col("id").alias("low")), graph.edges.groupBy("src").agg(heaviest))
    low, src, dst = F.col("low"), F.col("src_low"), F.col("dst_low")
    found = pregel(
        followed,
        F.lit(None).cast("long"),
        lambda message: {"low": F.least(low, message)},
        merge=F.min,
        to_dst=F.when(src < dst, src),
        to_src=F.when(dst < src, dst),
        direction="either",
    )
    return found.vertices.select("id", F.col("low").alias("component"))


# comment graph


@_query
def comment_vertices(spark, folder):
    return texts.numbered_vertices(_comments(spark, folder))


@_query
def comment_sources(spark, folder):
    graph = texts.comment_graph(_comments(spark, folder), _corpus(spark, folder))
    return graph.sources().select("id.comment_id", "id.pos", "name")


@_query
def comment_sinks(spark, folder):
    graph = texts.comment_graph(_comments(spark, folder), _corpus(spark, folder))
    return graph.sinks().select("id.comment_id", "id.pos", "name")


@_query
def weighted_comment_edges(spark, folder):
    return texts.weighted_edges(_comments(spark, folder), _corpus(spark, folder), in_tasks=True)


@_query
def path_starts(spark, folder):
    return texts.path_starts(_comments(spark, folder))


@_query
def path_ends(spark, folder):
    return texts.path_ends(_comments(spark, folder))


# labels and segmented text


@_query
def label_chars(spark, folder):
    labelled = segmentation.label_characters(_comments(spark, folder), _corpus(spark, folder), in_tasks=True)
    return labelled.select("comment_id", "pos", "ch", "label")


@_query
def segment_text(spark, folder):
    return segmentation.segment_texts(_comments(spark, folder), _corpus(spark, folder))


@_query
def segment_slice(spark, folder):
    part = texts.comment_slice(_comments(spark, folder))
    return segmentation.segment_texts(part, _corpus(spark, folder))


def _labelled_paths(spark: SparkSession, folder: str) -> DataFrame:
    labelled = segmentation.label_characters(_comments(spark, folder), _corpus(spark, folder), in_tasks=True)
    return labelled.select(F.col("comment_id").alias("path"), "pos", F.col("ch").alias("name"), "label")


@_query
def segment_labelled(spark, folder):
    glued = segmentation.glue_labels(_labelled_paths(spark, folder))
    return glued.withColumnRenamed("path", "comment_id")


@_query
def segment_relabelled(spark, folder):
    """The same with single words, middles and restarts among the labels: S for full stops, M, and U at line ends."""
    label = (
        F.when(F.col("name") == ".", "S")
        .when(F.col("name") == "\n", "U")
        .when((F.col("label") == "I") & (F.col("pos") % 2 == 1), "M")
        .otherwise(F.col("label"))
    )
    glued = segmentation.glue_labels(_labelled_paths(spark, folder).withColumn("label", label))
    return glued.withColumnRenamed("path", "comment_id")


@_query
def segment_slice_paths(spark, folder):
    """The texts of the slice as a graph without positions, which pointer doubling finds, and then glued."""
    part, corpus = texts.comment_slice(_comments(spark, folder)), _corpus(spark, folder)
    labelled = segmentation.label_characters(part, corpus)
    node = F.struct("comment_id", "pos")
    vertices = materialize(labelled.select(node.alias("id"), F.col("ch").alias("name"), "label"), "path-vertices")
    paths = Graph(vertices, texts.comment_graph(part, corpus).edges.select("src", "dst"))
    return segmentation.glue_paths(paths).select("path.comment_id", "segmented")


@_query
def cut_result_file(spark, folder):
    path = new_path(spark, "cutting-result")
    results.save_result_file(materialize(segment_text(spark, folder), "segmented"), path)
    return results.file_lines(results.read_result_file(spark, path))


@_query
def cut_result_lines(spark, folder):
    return results.result_lines(segment_text(spark, folder))


@_query
def export_nodes(spark, folder):
    labelled = segmentation.label_characters(_comments(spark, folder), _corpus(spark, folder), in_tasks=True)
    return results.export_nodes(labelled)


@_query
def export_edges(spark, folder):
    return results.export_edges(weighted_comment_edges(spark, folder))


# last, as it takes several jobs a round


@_query
def pregel_labels(spark, folder):
    labelled = segmentation.pregel_labels(_comments(spark, folder), _corpus(spark, folder))
    return labelled.vertices.select("id.comment_id", "id.pos", F.col("name").alias("ch"), "label")
