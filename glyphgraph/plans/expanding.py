"""Characters as rows, and counted pairs, made of stretches inside their task on arrays of code points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from ..functions.chars import CODE_POINT_RANGE, EXCLUDED_CHARACTERS
from ..operators.characters import UNIT_CHARACTERS
from .gluing import PairWeights, chunks, code_points, weights_beside

# Bytes of the stretches that become rows at a time: a character takes some forty bytes as one.
_ROW_BYTES = 1 << 18
# Pairs of alphabets up to this size are counted in a table of all of them; those of larger ones are sorted.
_COUNTED = 512

_LABELS = np.frombuffer(b"ABEI", np.uint8)


def _decoded(body: bytes | None) -> str:
    """A text as Spark's own functions see it: what is no UTF-8 is replaced."""
    return (body or b"").decode("utf-8", "replace")


def _strings(codes: np.ndarray, empty: np.ndarray) -> pa.Array:
    """Every code point as a string of its own, an empty one where `empty` says so."""
    sizes = 1 + (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
    sizes[empty] = 0
    offsets = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    data = codes[~empty].astype(np.uint32).tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets), pa.py_buffer(data))


def _letters(places: np.ndarray) -> pa.Array:
    """The labels at `places` of ABEI."""
    offsets = np.arange(len(places) + 1, dtype=np.int32)
    return pa.StringArray.from_buffers(len(places), pa.py_buffer(offsets), pa.py_buffer(_LABELS[places].tobytes()))


class _Characters:
    """The characters of some stretches one after the other; an empty stretch has an empty one, as Spark splits it."""

    def __init__(self, part: pa.RecordBatch, bodies: list, pairs: PairWeights):
        texts = [_decoded(body) for body in bodies]
        lengths = np.array([len(text) for text in texts], np.int64)
        filled = np.maximum(lengths, 1)
        bounds = np.concatenate([[0], np.cumsum(filled)])
        # an empty text leads to nothing and is led to by nothing, so its code counts for nothing
        self.codes = code_points("".join(text or "\0" for text in texts))
        self.empty = np.zeros(len(self.codes), bool)
        self.empty[bounds[:-1][lengths == 0]] = True
        self.before, self.after = part.column("before").to_pylist(), part.column("after").to_pylist()
        self.w_in, self.w_out = weights_beside(self.codes, bounds, self.before, self.after, pairs)
        self.owner = np.repeat(np.arange(len(texts)), filled)
        within = np.arange(len(self.codes)) - bounds[:-1][self.owner]
        self.pos = part.column("unit").to_numpy().astype(np.int64)[self.owner] * UNIT_CHARACTERS + within
        self.last = bounds[1:] - 1


def labelling(pairs: PairWeights, end_ratio: Callable) -> Callable:
    """For `mapInArrow`: stretches (comment_id, unit, before, body, after) to (comment_id, pos, ch, label, out_weight)."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bodies in chunks(batches, _ROW_BYTES):
            if not part.num_rows:
                continue
            c = _Characters(part, bodies, pairs)
            # the labels of `label_of`, by their places in ABEI
            found = np.where(c.w_out == 0, 2, np.where(10 * c.w_in < 7 * c.w_out, 1, np.where(end_ratio(c.w_in, c.w_out), 2, 3)))
            found[c.pos == 0] = 0
            columns = [part.column("comment_id").take(pa.array(c.owner)), pa.array(c.pos), _strings(c.codes, c.empty)]
            columns += [_letters(found), pa.array(c.w_out)]
            yield pa.RecordBatch.from_arrays(columns, ["comment_id", "pos", "ch", "label", "out_weight"])

    return label


def linking(pairs: PairWeights) -> Callable:
    """For `mapInArrow`: the same stretches to path edges (comment_id, pos, src_name, dst_name, weight)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bodies in chunks(batches, _ROW_BYTES):
            if not part.num_rows:
                continue
            c = _Characters(part, bodies, pairs)
            following = np.append(c.codes[1:], np.uint32(0))
            leads = np.ones(len(c.codes), bool)
            goes_on = np.array([bool(text) for text in c.after])
            leads[c.last[~goes_on]] = False
            if goes_on.any():
                following[c.last[goes_on]] = code_points("".join(text for text in c.after if text))
            none = np.zeros(int(leads.sum()), bool)
            columns = [part.column("comment_id").take(pa.array(c.owner[leads])), pa.array(c.pos[leads])]
            columns += [_strings(c.codes[leads], none), _strings(following[leads], none), pa.array(c.w_out[leads])]
            yield pa.RecordBatch.from_arrays(columns, ["comment_id", "pos", "src_name", "dst_name", "weight"])

    return link


class _PairCounts:
    """How often pairs of code points occur, for as many as come."""

    def __init__(self):
        self._place = np.zeros(CODE_POINT_RANGE, np.int32)
        self._letters = np.zeros(1, np.int64)
        self._table = np.zeros((_COUNTED, _COUNTED), np.int64)
        self._others: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        new = np.unique(np.concatenate([first[self._place[first] == 0], second[self._place[second] == 0]]))
        new = new[: _COUNTED - len(self._letters)]
        self._place[new] = len(self._letters) + np.arange(len(new))
        self._letters = np.concatenate([self._letters, new.astype(np.int64)])
        one, two = self._place[first], self._place[second]
        # place 0 is that of letters without one
        if len(self._letters) == _COUNTED and not (known := (one > 0) & (two > 0)).all():
            keys = first[~known].astype(np.int64) * CODE_POINT_RANGE + second[~known]
            self._others.append(np.unique(keys, return_counts=True))
            one, two = one[known], two[known]
        self._table += np.bincount(one * _COUNTED + two, minlength=_COUNTED**2).reshape(_COUNTED, _COUNTED)

    def found(self, most: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, count) of the pairs so far, which are forgotten; nothing if there are no more than `most` by themselves."""
        if most and sum(len(keys) for keys, _ in self._others) <= most:
            return (np.empty(0, np.int64),) * 3
        one, two = np.nonzero(self._table)
        keys = np.concatenate([k for k, _ in self._others] or [np.empty(0, np.int64)])
        counts = np.concatenate([n for _, n in self._others] or [np.empty(0, np.int64)])
        first = np.concatenate([self._letters[one], keys // CODE_POINT_RANGE])
        second = np.concatenate([self._letters[two], keys % CODE_POINT_RANGE])
        counts = np.concatenate([self._table[one, two], counts])
        self._others = []
        self._table[:] = 0
        return first, second, counts


# Pairs of large alphabets that a task holds before it gives them on.
_HELD = 1 << 20


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For `mapInArrow`: stretches (body, after) to counted pairs of which neither side is excluded: (src, dst, n)."""
    excluded = np.array([ord(ch) for ch in EXCLUDED_CHARACTERS], np.int64)
    counts = _PairCounts()

    def rows(most: int) -> Iterator[pa.RecordBatch]:
        first, second, n = counts.found(most)
        kept = ~(np.isin(first, excluded) | np.isin(second, excluded))
        none = np.zeros(int(kept.sum()), bool)
        if kept.any():
            columns = [_strings(first[kept], none), _strings(second[kept], none), pa.array(n[kept])]
            yield pa.RecordBatch.from_arrays(columns, ["src", "dst", "n"])

    for part, bodies in chunks(batches):
        texts = [_decoded(body) + (after or "") for body, after in zip(bodies, part.column("after").to_pylist(), strict=True)]
        lengths = np.array([len(text) for text in texts], np.int64)
        codes = code_points("".join(texts))
        if len(codes) > 1:
            ends = np.cumsum(lengths)[:-1]
            within = np.ones(len(codes) - 1, bool)
            within[ends[(ends > 0) & (ends < len(codes))] - 1] = False
            counts.add(codes[:-1][within], codes[1:][within])
            yield from rows(_HELD)
    yield from rows(0)
