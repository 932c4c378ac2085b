"""Byte-pair encoding and decoding by a token automaton.

The merges are compiled into a deterministic automaton whose arcs are labelled with tokens. It begins as
one state with an arc per byte. Each merge (u, v) -> w then adds a gadget, in order of rank: the arc w
beside every path u v, leading to a copy of the state after v, and the arc v cut from the state after u.
What is left at the end spells every word in exactly one way, the one that merging by rank gives. A state
is known by the arc that leads to it, so the table needs three entries a gadget; an arc that later gadgets
inherited is looked up along them once and then kept in the transition table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: how the vocabulary's files split a text into words before merging.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

# A task keeps the codes of at most this many distinct words; the next one starts again with none.
CACHED_WORDS = 400_000
# Longer words are encoded anew each time, so the cache stays small.
CACHED_WORD_LENGTH = 64

_DEAD, _ALIVE = False, True


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable, else U+0100 onwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class MergeAutomaton:
    """The compiled merges: states are the tokens that lead to them, arcs the tokens that may follow."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        base = {label[0]: token for token, label in labels.items() if len(label) == 1}
        spelled = {bytes([b]): token for b, token in base.items()}
        for rank, (u, v, w) in enumerate(merges):
            self._add_gadget(rank, u, v, w, spelled)
        self.gadgets = len(merges)
        # the trie of all arc labels: (node * 256 + byte) -> node, and the arc that ends at a node
        self.step: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for label, token in spelled.items():
            node = 0
            for byte in label:
                node = self.step.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = token
        self.spelled = spelled
        self.longest = max(map(len, spelled), default=0)

    def _add_gadget(self, rank: int, u: int, v: int, w: int, spelled: dict[bytes, int]) -> None:
        # without a path u v there is nothing to stand beside
        if not self._allows(u, v, rank):
            return
        self.cut[u, v] = rank
        self.left[w], self.right[w], self.born[w] = u, v, rank
        spelled.setdefault(self.labels[w], w)

    def _allows(self, state: int, arc: int, rank: int) -> bool:
        """Whether `state` has the arc after the gadgets below `rank`."""
        born, cut = self.born, self.cut
        while True:
            if cut.get((state, arc), rank) < rank:
                return _DEAD
            older, newer = born.get(state, -1), born.get(arc, -1)
            if older < 0 and newer < 0:
                return _ALIVE
            if older >= newer:
                # the state was copied from that after its right half, before its own gadget cut anything
                rank = older
                if older == newer:
                    arc = self.left[arc]
                state = self.right[state]
            else:
                # the arc stands wherever its left half stood, once its gadget had cut
                rank = newer + 1
                arc = self.left[arc]

    def allows(self, state: int, arc: int) -> bool:
        known = self.arcs.get((state, arc))
        if known is None:
            known = self.arcs[state, arc] = self._allows(state, arc, self.gadgets)
        return known

    def _arcs_at(self, word: bytes, place: int) -> list[int]:
        """The arcs whose labels come next in the word, shortest first."""
        step, ends, node, found = self.step, self.ends, 0, []
        for byte in word[place : place + self.longest]:
            node = step.get(node << 8 | byte)
            if node is None:
                break
            if ends[node] >= 0:
                found.append(ends[node])
        return found

    def encode(self, word: bytes) -> list[int]:
        """The labels on the one path that spells the word. Each place is left for good at most once."""
        whole = self.spelled.get(word)
        if whole is not None:
            return [whole]
        labels, known = self.labels, self.arcs
        path: list[int] = []
        options = [self._arcs_at(word, 0)]
        place, places, closed, end = 0, [0], set(), len(word)
        while place < end:
            choices = options[-1]
            state = path[-1] if path else None
            while choices:
                arc = choices.pop()
                after = place + len(labels[arc])
                if after in closed:
                    continue
                if state is not None:
                    allowed = known.get((state, arc))
                    if not (self.allows(state, arc) if allowed is None else allowed):
                        continue
                path.append(arc)
                places.append(after)
                place = after
                if after < end:
                    options.append(self._arcs_at(word, after))
                break
            else:
                # no arc leads on from here: the path to this place is unique, so nothing else does either
                closed.add(place)
                places.pop()
                options.pop()
                path.pop()
                place = places[-1]
        return path


class Tokenizer:
    """Encoding and decoding of whole texts, from the parts of a vocabulary file."""

    def __init__(self, vocabulary: str):
        parts = json.loads(vocabulary)
        alphabet = byte_alphabet()
        names = parts["model"]["vocab"]
        labels = {i: bytes(alphabet[c] for c in name) for name, i in names.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in parts["model"]["merges"]]
        merges = [(names[a], names[b], names[a + b]) for a, b in pairs]
        self.automaton = MergeAutomaton(labels, merges)
        self.added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.labels = labels | {i: content.encode() for content, i in self.added.items()}
        self.words = regex.compile(WORD_PATTERN)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.codes: dict[str, bytes] = {}

    def _code(self, word: str) -> bytes:
        return np.array(self.automaton.encode(word.encode()), dtype="<u4").tobytes()

    def _encode_plain(self, text: str) -> bytes:
        words, codes = self.words.findall(text), self.codes
        once = {}
        for word in [w for w in set(words) if w not in codes]:
            if len(word) > CACHED_WORD_LENGTH:
                once[word] = self._code(word)
            else:
                codes[word] = self._code(word)
        if once:
            return b"".join([once.get(w) or codes[w] for w in words])
        code = b"".join([codes[w] for w in words])
        if len(codes) > CACHED_WORDS:
            codes.clear()
        return code

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.marks is None:
            return self._encode_plain(text)
        parts, start = [], 0
        for mark in self.marks.finditer(text):
            parts.append(self._encode_plain(text[start : mark.start()]))
            parts.append(self.added[mark.group()].to_bytes(4, "little"))
            start = mark.end()
        parts.append(self._encode_plain(text[start:]))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """Emits the label of each arc; bytes that are no UTF-8 come out as the replacement character."""
        labels = self.labels
        data = b"".join([labels[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        return data.decode("utf-8", errors="replace")


# one tokenizer per Python worker and vocabulary: compiling takes about a second
_COMPILED: dict[str, Tokenizer] = {}


def _tokenizer(vocabulary: str) -> Tokenizer:
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Tokenizer(vocabulary)
    return _COMPILED[key]


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text, read by the driver and sent to the tasks (a few MB, whatever the data)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


OUTPUTS = {
    "n_tokens": ("n_tokens long", pa.int64()),
    "ids": ("ids array<int>", pa.list_(pa.int32())),
    "decoded": ("decoded string", pa.string()),
    "ids_sha256": ("ids_sha256 string", pa.string()),
    "decoded_sha256": ("decoded_sha256 string", pa.string()),
}


def encode_texts(
    docs: DataFrame,
    vocabulary_path: str,
    *,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    outputs: tuple[str, ...] = ("n_tokens", "ids"),
) -> DataFrame:
    """Encode (and decode again) every whole text; one row per row, no shuffle.

    `outputs` names what to add to the columns in `keep`: n_tokens, ids, decoded (the text decoded from the
    ids), ids_sha256, decoded_sha256. A NULL text counts as empty: no ids, and an empty decoded text.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    kept = docs.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(OUTPUTS[o][0] for o in outputs)])
    decodes = any(o.startswith("decoded") for o in outputs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(sent.value)
        for batch in batches:
            # a few rows at a time, so that long texts never stand beside many codes
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = {o: [] for o in outputs}
                for value in part.column(part.num_columns - 1):
                    code = tokenizer.encode(value.as_py() or "")
                    decoded = tokenizer.decode(code) if decodes else ""
                    for o, values in made.items():
                        if o == "n_tokens":
                            values.append(len(code) // 4)
                        elif o == "ids":
                            values.append(np.frombuffer(code, dtype="<i4"))
                        elif o == "decoded":
                            values.append(decoded)
                        else:
                            data = code if o == "ids_sha256" else decoded.encode()
                            values.append(hashlib.sha256(data).hexdigest())
                columns = part.columns[:-1] + [pa.array(made[o], OUTPUTS[o][1]) for o in outputs]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], *outputs])

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(encode, schema)


def decode_ids(frame: DataFrame, vocabulary_path: str, *, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The texts of a column of id arrays: (*keep, decoded). NULL gives NULL."""
    sent = frame.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    kept = frame.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "decoded string"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(sent.value)
        for batch in batches:
            values = batch.column(batch.num_columns - 1).to_pylist()
            texts = [None if v is None else tokenizer.decode(np.array(v, dtype="<u4").tobytes()) for v in values]
            columns = batch.columns[:-1] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "decoded"])

    return frame.select(*keep, frame[ids].alias("_ids")).mapInArrow(decode, schema)
