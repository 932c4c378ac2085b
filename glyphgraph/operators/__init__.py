from .characters import adjacent_pairs, all_characters, text_units, unit_characters
from .constants import ConstantTable
from .graph import Graph
from .ids import dense_ids, positions, running_totals
from .lookup import BROADCAST_BYTES, fits_broadcast, lookup_join, materialize_sized
from .merging import concat_sorted, merge_in_order
from .paths import path_positions
from .pregel import pregel
from .slices import deep_slice
from .storage import Tables, materialize, shared_dir

__all__ = [
    "BROADCAST_BYTES",
    "ConstantTable",
    "Graph",
    "Tables",
    "adjacent_pairs",
    "all_characters",
    "concat_sorted",
    "deep_slice",
    "dense_ids",
    "fits_broadcast",
    "lookup_join",
    "materialize",
    "materialize_sized",
    "merge_in_order",
    "path_positions",
    "positions",
    "pregel",
    "running_totals",
    "shared_dir",
    "text_units",
    "unit_characters",
]
