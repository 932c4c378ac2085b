"""Rows that lie one after the other as one row, before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(column: pa.Array) -> np.ndarray:
    """For every row but the first, whether it differs from the one before; what cannot be compared counts as different."""
    n = max(len(column) - 1, 0)
    if pa.types.is_struct(column.type):
        found = _differ(column.is_null())
        for part in column.flatten():
            found |= changes(part)
        return found
    if pa.types.is_nested(column.type):
        return np.ones(n, dtype=bool)
    unlike = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)
    return unlike.to_numpy(zero_copy_only=False) | _differ(column.is_null())


def _differ(flags: pa.Array) -> np.ndarray:
    values = flags.to_numpy(zero_copy_only=False)
    return values[1:] != values[:-1]


# Where the space of a label goes: after the name, before it or neither. Any other label restarts the text.
_SIDES = {"E": 1, "S": 1, "B": -1, "I": 0, "M": 0}
_RESTARTS = len(_SIDES)


def _kinds(label: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every label whether it restarts the text, and the side of its space."""
    place = pc.fill_null(pc.index_in(label, value_set=pa.array(list(_SIDES), label.type)), _RESTARTS).to_numpy(zero_copy_only=False)
    return place == _RESTARTS, np.array([*_SIDES.values(), 0], np.int8)[place]


def _joined(names: pa.Array, side: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The names from each start to before the next with their spaces, joined; NULL adds nothing."""
    names = pc.fill_null(names.cast(pa.large_string()), "")
    _, offsets, data = names.buffers()
    offsets = np.frombuffer(offsets, np.int64)[names.offset : names.offset + len(names) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    spaces = np.concatenate([[0], np.cumsum(side != 0)])
    # every byte moves by the spaces before its name, and by its own if that comes first
    made = np.full(len(data) + spaces[-1], ord(" "), np.uint8)
    made[np.arange(len(data)) + np.repeat(spaces[:-1] + (side < 0), np.diff(offsets))] = data
    ends = np.append(starts, len(names))
    bounds = offsets[ends] + spaces[ends]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(made)).cast(pa.string())


def joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, pos, name, label) to runs of rows: (path, pos, end, text, restarts, first_name, first_length, last_name, n).

    A run are rows of one path that come one after the other with places that do so too, and only its first may restart.
    Its text are the pieces of `glue_piece`, or the name where that is NULL.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        path, pos, name, label = (batch.column(c) for c in ("path", "pos", "name", "label"))
        place, known = pc.fill_null(pos, 0).to_numpy(zero_copy_only=False), pos.is_valid().to_numpy(zero_copy_only=False)
        restarts, side = _kinds(label)
        if name.null_count:
            nameless = name.is_null().to_numpy(zero_copy_only=False)
            restarts, side = restarts | nameless, np.where(nameless, 0, side)
        follows = known[1:] & known[:-1] & (place[1:] > place[:-1]) & (place[1:] - place[:-1] == 1)
        follows &= ~restarts[1:] & ~changes(path)
        starts = np.flatnonzero(np.concatenate([[True], ~follows]))
        ends = np.append(starts[1:], batch.num_rows) - 1
        first, last = pa.array(starts), pa.array(ends)
        first_name = name.take(first)
        made = {
            "path": path.take(first),
            "pos": pos.take(first),
            "end": pos.take(last),
            "text": _joined(name, side, starts),
            "restarts": pa.array(restarts[starts]),
            "first_name": first_name,
            "first_length": pc.add(pc.utf8_length(first_name), pa.array((side[starts] != 0).astype(np.int32))).cast(pa.int32()),
            "last_name": name.take(last),
            "n": pa.array(ends - starts + 1),
        }
        yield pa.RecordBatch.from_arrays(list(made.values()), list(made))
