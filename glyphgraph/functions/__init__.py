from .chars import (
    EXCLUDED_CHARACTERS,
    char_code,
    is_kept,
    let,
    pair_key,
    pair_keys,
    vertex_number,
)
from .labels import END_RATIO_FRACTIONAL, END_RATIO_INTEGER, display_label, glue_piece, label_of

__all__ = [
    "EXCLUDED_CHARACTERS",
    "END_RATIO_FRACTIONAL",
    "END_RATIO_INTEGER",
    "char_code",
    "display_label",
    "glue_piece",
    "is_kept",
    "label_of",
    "let",
    "pair_key",
    "pair_keys",
    "vertex_number",
]
