"""Labelling and gluing the stretches of texts inside their task, on arrays of code points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from ..functions.chars import CODE_POINT_RANGE

# Alphabets up to this size have a table of all their pairs; pairs of larger ones are searched.
_DENSE = 1024
# Bytes of the stretches that are glued at a time.
_CHUNK_BYTES = 1 << 20


class PairWeights:
    """Weights by pair key, 0 for any other pair."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        # the last entry is found for what is above all keys
        self._keys, self._weights = np.append(keys[order], -1), np.append(weights[order], 0)
        letters = np.unique(np.concatenate([keys // CODE_POINT_RANGE, keys % CODE_POINT_RANGE]))
        self._table = None
        if len(letters) < _DENSE:
            self._size = len(letters) + 1
            self._place = np.zeros(CODE_POINT_RANGE, np.int32)
            self._place[letters] = np.arange(1, self._size)
            self._table = np.zeros(self._size**2, np.int64)
            self._table[self._at(keys // CODE_POINT_RANGE, keys % CODE_POINT_RANGE)] = weights

    def _at(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self._place[first] * self._size + self._place[second]

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        if self._table is not None:
            return self._table[self._at(first, second)]
        keys = first.astype(np.int64) * CODE_POINT_RANGE + second
        found = np.searchsorted(self._keys[:-1], keys)
        return np.where(self._keys[found] == keys, self._weights[found], 0)


def chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int = _CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of the batches that hold so many bytes of stretches, and these as bytes."""
    for batch in batches:
        bodies = batch.column("body").cast(pa.binary()).to_pylist()
        sizes = np.cumsum([len(body or b"") for body in bodies])
        cuts = np.flatnonzero(np.diff(sizes // chunk_bytes)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(start, end - start), bodies[start:end]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def weights_beside(
    codes: np.ndarray, bounds: np.ndarray, before: list, after: list, pairs: PairWeights
) -> tuple[np.ndarray, np.ndarray]:
    """The weights of the pairs that end and that begin at every character of stretches, which lie one after the other."""
    w_out = np.append(pairs.of(codes[:-1], codes[1:]), 0)
    w_in = np.concatenate([[0], w_out[:-1]])
    some = np.diff(bounds) > 0
    first, last = bounds[:-1][some], bounds[1:][some] - 1
    for weight, place, outer, is_before in ((w_in, first, before, True), (w_out, last, after, False)):
        weight[place] = 0
        outer = [text for text, kept in zip(outer, some, strict=True) if kept]
        known = np.array([bool(text) for text in outer])
        if known.any():
            near = code_points("".join(text for text in outer if text))
            own = codes[place[known]]
            weight[place[known]] = pairs.of(near, own) if is_before else pairs.of(own, near)
    return w_in, w_out


def _glued(bodies: list[bytes], before: list, after: list, unit: np.ndarray, pairs: PairWeights, end_ratio: Callable) -> list[bytes]:
    """Stretches with the spaces that the labels of their characters ask for. Bytes that are no UTF-8 stay as they are."""
    bodies = [body.decode("utf-8", "surrogateescape") for body in bodies]
    lengths = np.array([len(body) for body in bodies])
    codes = code_points("".join(bodies))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    if not len(codes):
        return [b""] * len(bodies)
    w_in, w_out = weights_beside(codes, bounds, before, after, pairs)
    # the labels of `label_of`: a space after the character, before it or none
    side = np.where(w_out == 0, 1, np.where(10 * w_in < 7 * w_out, -1, np.where(end_ratio(w_in, w_out), 1, 0)))
    # the first character of a text has the label of a start, whatever its weights
    side[bounds[:-1][(lengths > 0) & (unit == 0)]] = 0
    spaces = np.concatenate([[0], np.cumsum(side != 0)])
    made = np.full(len(codes) + spaces[-1], ord(" "), np.uint32)
    made[np.arange(len(codes)) + spaces[:-1] + (side < 0)] = codes
    text, ends = made.tobytes().decode("utf-32-le", "surrogatepass"), bounds + spaces[bounds]
    return [text[a:b].encode("utf-8", "surrogateescape") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def gluing(pairs: PairWeights, end_ratio: Callable) -> Callable:
    """For `mapInArrow`: stretches (comment_id, unit, before, body, after) to (comment_id, unit, segmented)."""

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in chunks(batches):
            before, after = part.column("before").to_pylist(), part.column("after").to_pylist()
            texts = _glued([b or b"" for b in own], before, after, part.column("unit").to_numpy(), pairs, end_ratio)
            made = pa.array([None if b is None else t for b, t in zip(own, texts, strict=True)], pa.binary())
            columns = [part.column("comment_id"), part.column("unit"), made.view(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["comment_id", "unit", "segmented"])

    return glue
