"""Texts of an Arrow batch as numpy arrays: bytes, words, hashes.

Everything here works on a slice of one batch inside a task. A slice holds at most CHUNK_BYTES of text
(or one text, when that is longer), which bounds the memory of the arrays built from it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

# Fixed value: the bytes that separate words, [\x20\x09-\x0D].
_SEPARATORS = b" \t\n\x0b\x0c\r"

IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[list(_SEPARATORS)] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# stands for a NULL id in integer arrays: larger than every other id
NO_ID = np.iinfo(np.int64).max


def _seeded_table(seed: bytes, n: int) -> np.ndarray:
    digest = b"".join(hashlib.sha256(seed + i.to_bytes(4, "little")).digest() for i in range((n + 3) // 4))
    return np.frombuffer(digest, dtype="<u8")[:n].copy()


_BYTE_VALUES = _seeded_table(b"byte", 256)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
# The key of the hashes of spans: what a byte is worth at each place.
_PLACE_KEY = np.uint64(0x9E3779B97F4A7C15)
_LENGTH_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)
_WORD_BASE = np.uint64(0xD1342543DE82EF95)


def mix(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins; NULL counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def ids_of(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), int(NO_ID)).to_numpy(zero_copy_only=False)


def id_array(ids) -> pa.Array:
    """The reverse of `ids_of`."""
    ids = np.asarray(ids, dtype=np.int64)
    return pa.array(ids, mask=ids == NO_ID)


def chunks(
    batches: Iterator[pa.RecordBatch], text: str = "text", chunk_bytes: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `chunk_bytes` of text, or one row when that alone is longer."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + chunk_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and the number of words before each text (one more than texts)."""
    inside = ~IS_SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    if len(data):
        # a word never goes on into the next text
        edges = starts[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
    begins = np.flatnonzero(first)
    return begins, np.flatnonzero(last) + 1, np.searchsorted(begins, starts)


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: the sum of its bytes times random factors of their places in the span.

    The factors are keyed and of no regular kind, unlike the powers of a base, which make texts of regular structure
    collide for every base when taken modulo a power of two.
    """
    sizes = ends - begins
    offsets = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    place = np.arange(total) - np.repeat(offsets, sizes)
    factors = mix((np.arange(int(sizes.max(initial=0)), dtype=np.uint64) + np.uint64(1)) * _PLACE_KEY)
    sums = np.zeros(total + 1, dtype=np.uint64)
    values = data[place + np.repeat(begins, sizes)].astype(np.uint64) + np.uint64(1)
    np.cumsum(values * factors[place], out=sums[1:])
    return mix(sums[offsets + sizes] - sums[offsets] + sizes.astype(np.uint64) * _LENGTH_FACTOR)


def rolling_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one prefix sum over all of them.

    For very many overlapping spans, and only to choose among them: unlike texts of regular structure collide.
    """
    powers = np.full(len(data) + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers[:-1], out=sums[1:])
    powers[1:] = _BASE_INVERSE
    np.multiply.accumulate(powers, out=powers)
    return mix((sums[ends] - sums[begins]) * powers[begins] + (ends - begins).astype(np.uint64))


def sequence_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The Rabin-Karp hash of every run of `length` word hashes; one per place where a run starts."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        total *= _WORD_BASE
        total += words[i : i + n]
    return mix(total)


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def unpacked(blobs: pa.Array | pa.ChunkedArray, dtype) -> np.ndarray:
    """The arrays of all rows of a binary column, one after the other."""
    return np.frombuffer(b"".join(blobs.to_pylist()), dtype=dtype)
