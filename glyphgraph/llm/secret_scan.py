"""Secret scan with a trigram inverted index.

From each rule's pattern follows which trigrams a match must hold: a disjunction of sets, one for each way
through the pattern's alternatives. An index of these trigrams over the lower-cased texts is written once;
a rule's candidates are the documents in whose postings one of the sets is whole, and only they are matched
against the pattern. A rule for which some way holds no trigram is matched against every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import materialize

_BREAK = "\0"
_MAX_WAYS = 64


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` are secrets when capture group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int


def any_case(pattern: str) -> str:
    """ASCII letters of a pattern in either case, whatever the regex engine thinks of case."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


# What counts as a secret. The last two patterns state the least length themselves, which gives
# the same matches as dropping shorter ones, as both take whole runs of their characters.
RULES = (
    Rule(
        "assign",
        f"({any_case('password|passwd|secret|token|api_?key')})"
        + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
)


def literal_ways(pattern: str) -> list[str]:
    """The literal text on each way through a pattern, lower-cased, with a break where anything may stand."""
    return [re.sub(f"{_BREAK}+", _BREAK, way) for way in _ways(re._parser.parse(pattern))]


def _ways(parts) -> list[str]:
    ways = [""]
    for op, value in parts:
        name = str(op)
        if name == "LITERAL":
            options = [chr(value).lower()]
        elif name == "IN":
            members = {chr(v).lower() for o, v in value if str(o) == "LITERAL"}
            options = list(members) if len(members) == 1 and all(str(o) == "LITERAL" for o, _ in value) else [_BREAK]
        elif name == "SUBPATTERN":
            options = _ways(value[-1])
        elif name == "BRANCH":
            options = [way for branch in value[1] for way in _ways(branch)]
        elif name == "MAX_REPEAT":
            least, most, inner = value
            once = _ways(inner)
            if (least, most) == (0, 1) and once != [_BREAK]:
                options = ["", *once]
            elif least == 0:
                options = [_BREAK]
            else:
                options = [f"{_BREAK if least > 1 else ''}{way}{_BREAK}" for way in once]
        elif name == "AT":
            options = [""]
        else:
            options = [_BREAK]
        if len(ways) * len(options) > _MAX_WAYS:
            options = [_BREAK]
        ways = [a + b for a, b in product(ways, options)]
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The sets of trigrams of which a match holds at least one whole; None when the rule needs a full scan."""
    sets = set()
    for way in literal_ways(pattern):
        pieces = way.split(_BREAK)
        sets.add(frozenset(p[i : i + 3] for p in pieces for i in range(len(p) - 2)))
    if frozenset() in sets:
        return None
    # a set that holds another one asks for more than is needed
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The postings (trigram, doc_id): which of the given trigrams each lower-cased text holds."""
    lowered = F.lower(F.coalesce("text", F.lit("")))
    held = F.array(*(F.when(lowered.contains(t), F.lit(t)) for t in trigrams))
    return docs.select("doc_id", F.explode(F.array_compact(held)).alias("trigram")).select("trigram", "doc_id")


def candidates(postings: DataFrame, trigrams: list[str], queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """Intersected postings: (found_id, then for each rule whether one of its sets is whole)."""
    words = [trigrams[i : i + 63] for i in range(0, len(trigrams), 63)]
    bits = {t: (w, 1 << b) for w, word in enumerate(words) for b, t in enumerate(word)}
    one = F.create_map(*(F.lit(x) for t, (_, bit) in bits.items() for x in (t, bit)))
    masks = [
        F.coalesce(F.bit_or(F.when(F.col("trigram").isin(word), one[F.col("trigram")])), F.lit(0)).alias(f"mask{w}")
        for w, word in enumerate(words)
    ]

    def whole(trigram_set: frozenset[str]) -> Column:
        need = [sum(bits[t][1] for t in trigram_set if bits[t][0] == w) for w in range(len(words))]
        return reduce(
            Column.__and__, (F.col(f"mask{w}").bitwiseAND(F.lit(n)) == n for w, n in enumerate(need))
        )

    # bit sets are combined on the map side, so a trigram of many documents costs no more than a rare one
    return (
        postings.groupBy(F.col("doc_id").alias("found_id"))
        .agg(*masks)
        .select(
            "found_id",
            *(reduce(Column.__or__, map(whole, sets)).alias(f"maybe_{kind}") for kind, sets in queries.items()),
        )
    )


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """The spans of a rule's secrets as structs (begin, number, end), in code points."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    matches = F.arrays_zip(gaps.alias("gap"), found.alias("found"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<struct<begin:int,number:int,end:int>>").alias("spans"))

    def add(state: Column, match: Column) -> Column:
        begin = state["at"] + F.char_length(match["gap"])
        end = begin + F.coalesce(F.char_length(match["found"]), F.lit(0))
        span = F.struct(begin.alias("begin"), F.lit(number).alias("number"), end.alias("end"))
        # the last gap has no match after it
        counts = F.coalesce(F.char_length(match["value"]) >= rule.least, F.lit(False))
        spans = F.when(counts, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(matches, start, add, lambda state: state["spans"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The secrets of every text: (doc_id, secrets), one row per row.

    `secrets` are structs (begin, number, end) by begin and number of the rule, in code points, end
    exclusive. `docs` has doc_id and text; other columns are ignored. NULL text counts as empty. Rows that
    share a doc_id, or have none, share their candidates, and each is matched against the patterns itself.
    """
    docs = docs.select("doc_id", "text")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: sets for kind, sets in queries.items() if sets is not None}
    trigrams = sorted({t for sets in indexed.values() for s in sets for t in s})
    text = F.coalesce("text", F.lit(""))
    if indexed:
        postings = materialize(trigram_index(docs, trigrams), "postings")
        maybe = candidates(postings, trigrams, indexed)
        # candidates grow with the texts, so they are never broadcast
        docs = docs.join(maybe.hint("merge"), F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    none = F.expr("array()").cast("array<struct<begin:int,number:int,end:int>>")
    spans = []
    for number, rule in enumerate(rules):
        wanted = F.col(f"maybe_{rule.kind}") if rule.kind in indexed else text.rlike(rule.pattern)
        spans.append(F.when(wanted, _spans(text, rule, number)).otherwise(none))
    return docs.select("doc_id", F.array_sort(F.concat(*spans)).alias("secrets"))


def written(secrets: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(
        F.transform(secrets, lambda s: F.concat_ws(":", F.get(kinds, s["number"]), s["begin"], s["end"])), ","
    )
