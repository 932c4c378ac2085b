"""Conversation repair against a plain shortest-path search over whole conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from glyphgraph.llm import catalogue, conversations

SCHEMA = "conv_id long, turn long, role string, text string, audit string, head boolean, fault int, first string, n int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", True, 1, "y", 2) for r in rows], SCHEMA).repartition(parts)


def least_edits(rows):
    """(cost, edits) by relaxing every place and state from the end, ties to the least string."""
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    due = [2, 2, 3, 2]
    following = None
    for i in range(len(rows), -1, -1):
        best = [(0, "") if i == len(rows) and s in (0, 3) else None for s in range(4)]
        for s in range(4):
            if i < len(rows):
                initial, fault = rows[i]
                options = [(4, "D", s)]
                if fault not in ("blank", "duplicate"):
                    extra = 3 if fault == "truncated" else 0
                    options.append((3 + extra, "R", due[s]))
                    if (s, initial) in keep:
                        options.append((extra, "K", keep[s, initial]))
                best[s] = min((c + following[t][0], e + following[t][1]) for c, e, t in options)
        for _ in range(5):
            for s in range(4):
                if best[due[s]] is not None:
                    found = (3 + best[due[s]][0], "I" + best[due[s]][1])
                    best[s] = found if best[s] is None else min(best[s], found)
        following = best
    return following[0]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows):
    groups = defaultdict(list)
    for row in damaged(rows):
        groups[row[0]].append(row)
    result = {}
    for conv in {r[0] for r in rows}:
        # rows of one turn are ordered by role and a digest of role and text
        def key(r):
            content = f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()
            return (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(content).digest())

        mine = sorted(groups[conv], key=key)
        seen, codes = set(), []
        for _, _, role, text in mine:
            inside = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not inside else "duplicate" if (role, text) in seen else "" if inside[-1] in ".!?" else "truncated"
            seen.add((role, text))
            codes.append((role[:1], fault))
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(codes))
        cost, edits = least_edits(codes)
        state, place, repaired = 0, 0, []
        names, due, after = ["user", "user", "assistant", "user"], [2, 2, 3, 2], {"s": 1, "u": 2, "a": 3}
        for e in edits:
            if e == "I":
                repaired.append(names[state] + ":")
                state = due[state]
                continue
            role, text = mine[place][2:]
            place += 1
            if e == "D":
                continue
            role = names[state] if e == "R" else role
            repaired.append(f"{role}:{text}")
            state = due[state] if e == "R" else after[role[:1]]
        faults = [f for _, f in codes]
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        result[conv] = (conv, gaps, *counts, illegal, cost, edits, digest)
    return sorted(result.values(), key=repr)


def random_rows(seed, conversations=120, longest=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \t\r\n", "Why?  ", "é😀!", "a:b.", None, "x" * 3000, "Go on.\r\n"]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "sales", "uncle"]
    return [
        (conv, rng.choice([t, t, t, t, None]), rng.choice(roles[:3] if (conv or 0) % 2 else roles), rng.choice(texts))
        for conv in [*range(conversations), None]
        for t in range(rng.randrange(longest))
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_cheapest_edits_of_any_rows(seed):
    rng = random.Random(seed)
    for _ in range(400):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.randrange(4)) for _ in range(rng.randrange(14))]
        names = ["", "blank", "duplicate", "truncated"]
        want = least_edits([(initial, names[fault]) for initial, fault in rows])
        for stretch in (1, 2, 3, 5, 48):
            assert conversations.repair_edits(rows, stretch) == want


@pytest.mark.parametrize("seed", [3, 4])
def test_repaired_conversations(spark, seed):
    catalogue.find_package(spark)
    rows = random_rows(seed)
    found = conversations.repair_conversations(table(spark, rows))
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows)


def test_a_conversation_of_very_many_rows(spark):
    catalogue.find_package(spark)
    rng = random.Random(5)
    roles = ["user", "assistant", "user", "assistant", "system"]
    rows = [(7, t, rng.choice(roles), rng.choice(["Yes.", "No"]) * rng.randrange(3) + str(t % 900)) for t in range(4000)]
    rows += [(8, None, "user", "Same."), (8, None, "user", "Same."), (9, 3, "assistant", None)]
    found = conversations.repair_conversations(table(spark, rows))
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows)


def test_a_whole_conversation_can_be_lost(spark):
    catalogue.find_package(spark)
    lost = [(c, 0, "user", "Hm.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert lost
    found = conversations.repair_conversations(table(spark, lost)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, found)) == [(c, 0, 0, 0, 0, 0, 0, "", empty) for c, *_ in lost]


def test_no_conversations(spark):
    catalogue.find_package(spark)
    assert conversations.repair_conversations(table(spark, [])).count() == 0


def test_registered_query(spark, tmp_path):
    rows = random_rows(6)
    table(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    found = catalogue.all_queries()["op11_conversation_repair"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows)
