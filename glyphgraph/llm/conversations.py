"""Repair of a conversation's structure by the cheapest edits.

A good conversation is empty, or an optional system turn and then pairs of user and assistant turns. Edits keep a
row, give it the role that is due, delete it, or insert an empty turn of the role that is due; blank and repeated rows
have to go, and a truncated row that stays costs extra. Iterative deepening A* finds the cheapest edits: a depth-first
search tries the edits in ASCII order under a bound on the cost, which grows to the least cost that went beyond it. A
table keeps for each place and state the cost that is known to be needed from there, raised by every failed search;
it starts from what the faults ahead cost in any case. The first path that is accepted is the answer, so ties go to
the edits that are least in ASCII order.

A long conversation is searched in stretches of bounded length, from the last to the first, each from every state it
may begin in and with the cost of what follows as its end. An insertion belongs to the row after it, so no path
through a stretch is the beginning of another, and the first one within the bound is the one that is least overall.

NULL in any column counts as one space. Rows without a conv_id are one conversation. Rows of one conversation and
turn are ordered by role, then by a digest of role and text; rows that agree in these are equal. A conversation whose
rows were all dropped comes back with zeros, an empty audit and the digest of the empty string.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import materialize

# Rows searched at a time.
STRETCH = 24

# Costs of the edits, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED_STAYS = 4, 3, 3, 3
ENDS = "[.!?]"
SEPARATORS = r"[\x20\x09-\x0D]"

# What is wrong with a row: the first that holds.
FINE, BLANK, DUPLICATE, TRUNCATED, DROPPED = range(5)

# States of the search: nothing yet, after a system, a user, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# the state after a turn of the role that is due
_DUE = [USER, USER, ASSISTANT, USER]
_DUE_ROLE = ["user", "user", "assistant", "user"]
_LEGAL = {"su", "ua", "au"}

Row = tuple[str, int]


def cheapest_edits(rows: list[Row], state: int, after: list[float] | None) -> tuple[int, str, int]:
    """The cost from `state` over rows of (role initial, fault) to the end, the edits, and the state after them.

    `after` is the cost of what follows by state; None at the end of the conversation, where turns may be added.
    """
    n = len(rows)
    least = [min(after) if after is not None else 0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = rows[i][1]
        least[i] = least[i + 1] + (DELETE if fault in (BLANK, DUPLICATE) else TRUNCATED_STAYS if fault == TRUNCATED else 0)
    # the transposition table: the cost known to be needed from a place and state
    needed: list[float] = [cost for cost in least for _ in range(4)]
    path: list[str] = []

    def steps(i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        if i == n:
            if after is None:
                yield "I", INSERT, i, _DUE[state]
            return
        initial, fault = rows[i]
        yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, _DUE[state]
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED_STAYS if fault == TRUNCATED else 0
            kept = _KEPT.get((state, initial))
            if kept is not None:
                yield "K", extra, i + 1, kept
            yield "R", REROLE + extra, i + 1, _DUE[state]

    def search(i: int, state: int, left: float) -> tuple[float, int | None]:
        """What is needed from here; the last state if that is within what is left."""
        here = 4 * i + state
        if needed[here] > left:
            return needed[here], None
        if i == n:
            end = after[state] if after is not None else 0 if state in (START, ASSISTANT) else math.inf
            if end <= left:
                return end, state
            best = end
        else:
            best = math.inf
        for edit, cost, j, following in steps(i, state):
            rest = needed[4 * j + following]
            if cost + rest <= left:
                path.append(edit)
                rest, last = search(j, following, left - cost)
                if last is not None:
                    return rest, last
                path.pop()
            best = min(best, cost + rest)
        needed[here] = max(needed[here], best)
        return best, None

    bound = needed[state]
    while True:
        more, last = search(0, state, bound)
        if last is not None:
            return int(bound), "".join(path), last
        if math.isinf(more):
            raise ValueError("no edits lead to an accepted state")
        bound = more


def repair_edits(rows: list[Row], stretch: int = STRETCH) -> tuple[int, str]:
    """The cost and the edits of the cheapest repair of a whole conversation."""
    starts = list(range(0, len(rows), stretch)) or [0]
    after: list[float] | None = None
    found: list[list[tuple[int, str, int] | None]] = []
    for start in reversed(starts):
        states = range(4) if start else [START]
        part = rows[start : start + stretch]
        answers = [cheapest_edits(part, s, after) if s in states else None for s in range(4)]
        after = [a[0] if a is not None else math.inf for a in answers]
        found.append(answers)
    state, edits = START, []
    for answers in reversed(found):
        _, part_edits, state = answers[state]
        edits.append(part_edits)
    return int(after[START]), "".join(edits)


def _or_space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) after the damage, which a row's conversation and turn decide."""
    kind = F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_or_space("text"), ENDS, "")).otherwise(_or_space("text"))
    role = F.when(kind == 4, "user").otherwise(_or_space("role"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        rows.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            role.alias("role"),
            text.alias("text"),
            (kind == 0).alias("dropped"),
            copies.alias("copies"),
        )
        .withColumn("copy", F.explode("copies"))
        .drop("copies", "copy")
    )


def _keyed(damaged: DataFrame) -> DataFrame:
    """With a digest that tells rows of a conversation apart by role and text."""
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return damaged.withColumn("digest", F.unhex(F.sha2(content, 256)))


# ascending, so NULL comes first
_ORDER = ["conv_id", "turn", "role", "digest"]
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_AUDIT = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"
_REPAIRED = _AUDIT + ", repaired_sha256 string"


class _Conversation:
    """What the rows of a conversation leave while they pass by in order: two small values for each."""

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.turns: list[int] = []  # smallest, largest, number of distinct ones
        self.last: tuple | None = None

    def add(self, turn: int | None, initial: str, fault: int, digest: bytes) -> None:
        if fault == DROPPED:
            return
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1:] = [turn, self.turns[2] + 1]
        # equal rows of one turn stand side by side; those of other turns are marked already
        if fault in (FINE, TRUNCATED) and self.last == (turn, digest):
            fault = DUPLICATE
        self.last = turn, digest
        self.rows.append((initial, fault))

    def audit(self) -> tuple:
        faults = [fault for _, fault in self.rows]
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        pairs = zip(self.rows, self.rows[1:], strict=False)
        illegal = sum(a[0] + b[0] not in _LEGAL for a, b in pairs)
        cost, edits = repair_edits(self.rows)
        return gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, edits


class _Repaired:
    """The digest of a repaired conversation, from its rows in order."""

    def __init__(self, edits: str) -> None:
        self.edits, self.place, self.state = edits, 0, START
        self.digest, self.empty = hashlib.sha256(), True

    def _write(self, role: str, text: str) -> None:
        if not self.empty:
            self.digest.update(b"\n")
        self.empty = False
        self.digest.update(role.encode())
        self.digest.update(b":")
        self.digest.update(text.encode())

    def _insert(self) -> None:
        while self.edits[self.place : self.place + 1] == "I":
            self._write(_DUE_ROLE[self.state], "")
            self.state, self.place = _DUE[self.state], self.place + 1

    def add(self, role: str, text: str) -> None:
        self._insert()
        edit = self.edits[self.place]
        self.place += 1
        if edit == "K":
            self._write(role, text)
            self.state = _KEPT[self.state, role[:1]]
        elif edit == "R":
            self._write(_DUE_ROLE[self.state], text)
            self.state = _DUE[self.state]

    def hexdigest(self) -> str:
        self._insert()
        return self.digest.hexdigest()


def _batches(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


_KINDS = [pa.int64(), *[pa.int64()] * len(_COUNTS), pa.string()]
_NAMES = ["conv_id", *_COUNTS, "audit"]


def _emitting(finish: Callable, kinds: list[pa.DataType], names: list[str], begin: Callable, size: int = 1024) -> Callable:
    """A pass over sorted rows: `begin` at a conversation's first row, then `finish` on what its rows left."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, conv, out = None, None, []
        for batch in batches:
            for values in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if current is None or values[0] != conv:
                    if current is not None:
                        out.append(finish(conv, current))
                    conv, current = values[0], begin(values)
                current.add(*values[1:])
                if len(out) >= size:
                    yield _batches(out, kinds, names)
                    out = []
        if current is not None:
            out.append(finish(conv, current))
        if out:
            yield _batches(out, kinds, names)

    return work


class _Audited(_Repaired):
    """A repaired conversation whose first row brings its counts and edits."""

    def __init__(self, counts: list[int], edits: str) -> None:
        super().__init__(edits)
        self.counts = counts

    def add(self, *values) -> None:
        role, text = values[-2:]
        if role is not None:
            super().add(role, text)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Damage the rows of (conv_id, turn, role, text) and repair every conversation.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation.

    Faults are found row by row, repeated rows by a count per digest, so a conversation of very many rows is spread
    over all tasks there. Its rows then pass through one task in order, first without their texts, of which the task
    keeps two small values each, then with them; the digest of a conversation can only be made in order, and no more
    than one batch of texts is held for it.
    """
    damaged = _keyed(damage(rows))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(rf"{ENDS}{SEPARATORS}*\z")
    fault = F.when(F.col("dropped"), DROPPED).when(blank, BLANK).when(whole, FINE).otherwise(TRUNCATED)
    small = materialize(damaged.select("conv_id", "turn", "role", "digest", fault.alias("fault")), "turns")
    place = F.struct(F.col("turn").isNotNull(), "turn")
    seen = small.where(F.col("fault") != DROPPED).groupBy("conv_id", "digest")
    # only what occurs more than once can be a repetition
    again = seen.agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("other_conv"), F.col("digest").alias("other_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("other_conv")) & (F.col("digest") == F.col("other_digest"))
    repeated = F.col("fault").isin(FINE, TRUNCATED) & (F.col("first") < place)
    marked = small.join(again.hint("merge"), same, "left").select(
        "conv_id",
        "turn",
        F.left("role", F.lit(1)).alias("initial"),
        F.when(repeated, DUPLICATE).otherwise(F.col("fault")).alias("fault"),
        "digest",
        "role",
    )
    in_order = marked.repartition("conv_id").sortWithinPartitions(*_ORDER).drop("role")

    def audited(conv: int | None, conversation: _Conversation) -> tuple:
        return conv, *conversation.audit()

    audits = in_order.mapInArrow(_emitting(audited, _KINDS, _NAMES, lambda _: _Conversation()), _AUDIT)
    audits = materialize(audits, "audits")

    texts = damaged.where(~F.col("dropped")).select("conv_id", "turn", "digest", "role", "text")
    nothing = {"turn": "long", "digest": "binary", "role": "string", "text": "string"}
    heads = audits.select("*", *[F.lit(None).cast(k).alias(c) for c, k in nothing.items()], F.lit(True).alias("head"))
    bodies = texts.select("*", F.lit(False).alias("head"))
    together = heads.unionByName(bodies, allowMissingColumns=True).repartition("conv_id")
    # a conversation's counts and edits come before its texts
    together = together.sortWithinPartitions("conv_id", F.desc("head"), *_ORDER[1:])

    def begin(values: tuple) -> _Audited:
        return _Audited(list(values[1 : 1 + len(_COUNTS)]), values[1 + len(_COUNTS)])

    def digested(conv: int | None, conversation: _Audited) -> tuple:
        return conv, *conversation.counts, conversation.edits, conversation.hexdigest()

    columns = [*_NAMES, "role", "text"]
    work = _emitting(digested, [*_KINDS, pa.string()], [*_NAMES, "repaired_sha256"], begin)
    return together.select(*columns).mapInArrow(work, _REPAIRED)
