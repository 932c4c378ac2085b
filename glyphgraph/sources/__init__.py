from .readers import (
    read_bigram_edges,
    read_bigram_json,
    read_comments,
    read_id_edges,
    read_json_lines,
    read_table,
    read_vertices,
)
from .registry import SourceRegistry
from .store import read_graph, save_graph
from .writers import save_bigram_edges, save_id_edges, save_result_text, save_table, save_vertices

__all__ = [
    "SourceRegistry",
    "read_bigram_edges",
    "read_bigram_json",
    "read_comments",
    "read_graph",
    "read_id_edges",
    "read_json_lines",
    "read_table",
    "read_vertices",
    "save_bigram_edges",
    "save_graph",
    "save_id_edges",
    "save_result_text",
    "save_table",
    "save_vertices",
]
