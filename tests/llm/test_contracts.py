"""Hostile texts, names, ids and tables, and what operators promise about them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphgraph.llm import ann, line_dedup, mixing, partenum, substring
from glyphgraph.llm.catalogue import find_package
from glyphgraph.operators.storage import Tables

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def table(spark):
    """documents from (doc_id, text) rows, with further columns of the given names."""
    find_package(spark)

    def make(rows, *names):
        full = [(i, t, "en", "src0", len(t or ""), *[7] * len(names)) for i, t in rows]
        return spark.createDataFrame(full, ", ".join([DOCS, *[f"{n} int" for n in names]])).repartition(3)

    return make


def rows(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


def complements(length):
    """Two texts of a and b that collide under every polynomial hash modulo a power of two."""
    text = "a"
    while len(text) < length:
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("length", [1024, 2048, 4096])
def test_regular_words_are_told_apart(table, length):
    one, other = complements(length)
    shared = [f"w{i}" for i in range(12)]
    docs = [(1, " ".join([*shared, one])), (2, " ".join([*shared, other])), (3, one), (4, other)]
    removed = rows(substring.remove_repeats(table(docs)), "doc_id", "n_removed")
    assert removed == [(i, 0) for i, _ in docs]
    docs = [(1, f"{one} x y z u"), (2, f"{other} x y z u"), (3, one), (4, other)]
    linked = rows(partenum.ngram_components(table(docs)), "doc_id", "component_id")
    assert linked == [(i, i) for i, _ in docs]


def test_unlike_sets_that_share_signatures_are_not_sent(table, monkeypatch):
    """Long passages of three texts each make groups of unlike sets; only those that can be similar are compared whole."""
    rng = random.Random(7)
    passages = [[f"p{n}x{i}" for i in range(140)] for n in range(20)]
    texts = [" ".join([*passages[i % 20], *(f"w{rng.randrange(10**6)}" for _ in range(100))]) for i in range(60)]
    texts += [f"{text} end" for text in texts[:3]]
    written = {}

    def recorded(frame, name, write=partenum.materialize):
        written[name] = write(frame, name)
        return written[name]

    monkeypatch.setattr(partenum, "materialize", recorded)
    found = rows(partenum.ngram_components(table(list(enumerate(texts)))), "doc_id", "component_id")
    assert found == sorted([(i, i - 60 if i >= 60 else i) for i in range(63)], key=repr)
    grouped = {i for (members,) in rows(written["groups"], "members") for i in members}
    assert len(grouped) > 40
    assert {i for (i,) in rows(written["candidates"], "doc_id")} == {0, 1, 2, 60, 61, 62}


def test_sketches_allow_all_similar_sets():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 9, 40, 300, 5000):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        sets = [np.unique(base)]
        for share in (0.02, 0.05, 0.09):
            fresh = rng.integers(0, 1 << 63, int(size * share), dtype=np.uint64)
            sets += [np.unique(np.concatenate([base, fresh])), np.unique(np.concatenate([base[len(fresh) :], fresh]))]
        sets = [s for s in sets if 100 * len(np.intersect1d(s, sets[0])) >= 80 * len(np.union1d(s, sets[0]))]
        edges = np.cumsum([0, *map(len, sets)])
        made = partenum.sketches(np.concatenate(sets), edges)
        for i in range(1, len(sets)):
            assert list(partenum.may_link(np.diff(edges)[[0, i]], [made[0], made[i]]))
    # full cells tell nothing of what is above them
    full = [bytes([255] * 8), bytes([255] * 8)]
    assert list(partenum.may_link(np.array([4000, 4100]), full))


def vectors(spark, rows_):
    return spark.createDataFrame(rows_, "vec_id long, embedding array<double>").repartition(2)


def brute_neighbours(rows_, width, most=20):
    usable = [(i, v) for i, v in rows_ if i is not None and v is not None and len(v) == width]
    found = []
    for q, x in usable:
        if q % 20 == 0:
            others = sorted((-float(np.dot(x, v)), i) for i, v in usable if i != q)[:most]
            found += [(q, rank, i) for rank, (_, i) in enumerate(others, 1)]
    return sorted(found, key=repr)


def test_a_query_gets_all_candidates_there_are(spark):
    find_package(spark)
    rng = np.random.default_rng(1)
    some = [(i, rng.standard_normal(64).tolist()) for i in range(12)]
    assert rows(ann.nearest(vectors(spark, some)), "query_id", "rank", "vec_id") == brute_neighbours(some, 64)
    # a query far from everything has no bucket in common with anything
    many = [(i, (rng.standard_normal(16) * 0.01 + 1).tolist()) for i in range(1, 300)]
    many.append((0, (-np.ones(16) * 50).tolist()))
    found = ann.nearest(vectors(spark, many)).where("query_id = 0")
    assert rows(found, "query_id", "rank", "vec_id") == [r for r in brute_neighbours(many, 16) if r[0] == 0]


def test_one_odd_vector_loses_one_row(spark):
    find_package(spark)
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(8).tolist()) for i in range(1, 60)]
    found = ann.nearest(vectors(spark, [(0, [1.0, 2.0]), (None, good[0][1]), *good]))
    assert rows(found, "query_id", "rank", "vec_id") == brute_neighbours(good, 8)


def test_a_domain_without_target_keeps_its_documents(table):
    docs = [(i, {0: "rot", 1: "red", 2: "rouge"}[i % 3] + f" {i % 7} apfel"[: 6 + i % 3]) for i in range(90)]
    frame = table(docs)
    domain = "case doc_id % 3 when 0 then 'de' when 1 then 'en' else 'fr' end"
    labelled = frame.selectExpr("doc_id", "text", f"{domain} as domain")
    rates = mixing.fit_rates(frame, labelled, {"de": 0.75, "en": 0.25})
    total = [rates.selectExpr(f"sum(rate * n_tokens * posteriors[{i}])", f"sum(n_tokens * posteriors[{i}])").first() for i in range(3)]
    assert total[0][0] == pytest.approx(3 * total[1][0], rel=1e-4)
    assert total[2][0] == pytest.approx(total[2][1], rel=1e-4)
    # no domain shrinks, and every document is there
    assert all(new >= old * (1 - 1e-6) for new, old in total)
    written = mixing.apply_rates(frame, rates)
    assert {i for (i,) in rows(written, "doc_id")} == {i for i, _ in docs}


def test_rates_against_a_direct_solution(table):
    """The rates are those of least squares on the posteriors themselves, solved in one go."""
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["aa", "ab"] if i % 2 else ["ba", "bb", "aa"], k=1 + i % 9))) for i in range(120)]
    frame = table(docs)
    labelled = frame.selectExpr("doc_id", "text", "if(doc_id % 2 = 1, 'a', 'b') as domain")
    fitted = mixing.fit_rates(frame, labelled, {"a": 0.3, "b": 0.7}).collect()
    weights = np.array([[p * r["n_tokens"] for p in r["posteriors"]] for r in fitted])
    posteriors = np.array([r["posteriors"] for r in fitted])
    goal = mixing._goals(weights.sum(axis=0), [0.3, 0.7])
    move = np.linalg.solve(weights.T @ posteriors, goal - weights.sum(axis=0))
    expected = 1 + posteriors @ move
    assert (expected >= 0).all()
    assert np.allclose([r["rate"] for r in fitted], expected, rtol=1e-4)


def test_mixing_empty_tables(table):
    empty = table([])
    labelled = empty.selectExpr("doc_id", "text", "lang as domain")
    rates = mixing.fit_rates(empty, labelled, {"en": 1.0})
    assert rates.count() == 0 and mixing.apply_rates(empty, rates).count() == 0


LINES = "\r\n".join(["the quick brown fox jumps over the lazy dog near the river", "", "\t", "another one of the lines here"])


def test_lines_of_white_space_stay(table):
    docs = [(1, LINES), (2, f"{LINES}\r\n\r\nthe last line is its own")]
    found = dict(rows(line_dedup.remove_similar_lines(table(docs)), "doc_id", "text"))
    assert found[1] == LINES
    assert found[2].split("\n") == ["\r", "\t\r", "\r", "the last line is its own"]


def similar(a, b):
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} or {x} for x in (a, b)]
    return 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])


def test_lines_against_all_pairs(table):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randrange(2, 9))) for _ in range(400)]
    texts = []
    for n in (3, 6, 12, 25, 60):
        for _ in range(25):
            text = " ".join(rng.choices(words, k=n))
            for _ in range(rng.randrange(4)):
                place = rng.randrange(len(text))
                text = text[:place] + rng.choice(["#", "", "xx"]) + text[place + rng.randrange(2) :]
                texts.append(text)
    texts += ["", "ab", "ab", "a" * 70, "a" * 90, "abab" * 30, "语言" * 20, "语言" * 20 + "x"]
    rng.shuffle(texts)
    root = list(range(len(texts)))
    for j, b in enumerate(texts):
        for i, a in enumerate(texts[:j]):
            if a.strip() and b.strip() and (a == b or similar(a, b)) and root[i] != root[j]:
                root = [root[i] if r == root[j] else r for r in root]
    first = {}
    for i, r in enumerate(root):
        if texts[i].strip():
            first.setdefault(r, i)
    expected = {i for i, r in enumerate(root) if texts[i].strip() and first[r] != i}
    found = rows(line_dedup.remove_similar_lines(table(list(enumerate(texts)))), "doc_id", "n_removed")
    gone = {i for i, n in found if n}
    assert gone <= expected and len(gone) >= 0.97 * len(expected) and len(expected) > 40


@pytest.mark.parametrize("share", [16, 1])
def test_similar_lines_of_a_crowd_link(table, monkeypatch, share):
    """Lines that share nothing but common phrases with those like them, in bands of more than a hundred."""
    monkeypatch.setattr(line_dedup, "COMMON_SHARE", share)
    rng = random.Random(12)
    opening = "all of this was written by the people who once lived beside the old river and said"
    closing = "which is why nobody in the whole town has ever wanted to go back there since"
    texts = []
    for _ in range(60):
        # one long word between the phrases, so whatever holds it differs
        word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=90))
        texts += [f"{opening} {word} {closing}", f"{opening} {word[:45]}#{word[46:]} {closing}"]
    assert all(similar(a, b) for a, b in zip(texts[::2], texts[1::2], strict=True))
    assert not any(similar(texts[0], other) for other in texts[2:])
    found = rows(line_dedup.remove_similar_lines(table(list(enumerate(texts)))), "doc_id", "n_removed")
    assert {i for i, n in found if n} == set(range(1, 120, 2))


def test_parities_keep_all_similar_lines(spark):
    rng = random.Random(21)
    pairs = []
    for length in (1, 4, 6, 12, 30, 60, 150, 400, 1500):
        for edits in range(6):
            text = "".join(rng.choices("abcdefghijklmnop ", k=length))
            other = list(text)
            for _ in range(edits):
                other[rng.randrange(length)] = rng.choice("#x")
            pairs.append((len(pairs), text, "".join(other)))
    pairs += [(len(pairs) + i, a, b) for i, ((_, a, _), (_, b, _)) in enumerate(zip(pairs[24:36], pairs[30:42], strict=True))]
    frame = spark.createDataFrame(pairs, "i int, a string, b string")
    sides = []
    for side in "ab":
        bits = line_dedup._parities(line_dedup._shingles(F.col(side)))
        sides += [F.size(line_dedup._shingles(F.col(side))), bits["low"], bits["high"]]
    possible = dict(rows(frame.select("i", line_dedup._can_be_similar(*sides).alias("possible")), "i", "possible"))
    alike = [i for i, a, b in pairs if similar(a, b)]
    assert len(alike) > 20 and all(possible[i] for i in alike)
    assert sum(possible.values()) < len(pairs)


def test_texts_of_lines_go_before_the_crowd_is_searched(table, monkeypatch):
    """Lines are held once while pairs are searched, in the bucketed table."""
    held = []

    def searched(tables, crowd, lines, search=line_dedup._crowded_pairs):
        held.append(tables.names)
        return search(tables, crowd, lines)

    monkeypatch.setattr(line_dedup, "_crowded_pairs", searched)
    texts = [f"all of them have this in common and nothing else than this {'abcdefghijkl'[i]}{i * 7919}" * 2 for i in range(12)]
    line_dedup.remove_similar_lines(table(list(enumerate(texts)))).count()
    assert held and "line-candidates" in held[0] and "line-texts" not in held[0]


def test_a_crowd_sends_no_unlike_pairs(table, monkeypatch):
    """Unlike lines that share rare passages are told apart before their pairs are counted or verified."""
    rng = random.Random(22)
    texts, passages = [], ["".join(rng.choices("abcdefgh", k=30)) for _ in range(12)]
    for i in range(120):
        own = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(6))
        texts.append(f"to be read by all {passages[i % 12]} {own}")
    met = []

    def counted(tables, pairs, lines, name, verify=line_dedup._verified, **options):
        if name == "line-crowded":
            met.append(pairs.count())
        return verify(tables, pairs, lines, name, **options)

    monkeypatch.setattr(line_dedup, "MET", 1)
    monkeypatch.setattr(line_dedup, "_verified", counted)
    found = rows(line_dedup.remove_similar_lines(table(list(enumerate(texts)))), "doc_id", "n_removed")
    assert not any(n for _, n in found) and met == [0]


def _long_lines(n):
    """Unlike lines of more than 500 shingles, all of them common, that share a passage."""
    rng = random.Random(23)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 8))) for _ in range(150)]
    passage = " ".join(rng.choices(words, k=30))
    texts = [" ".join([*rng.choices(words, k=60), passage, *rng.choices(words, k=60)]) for _ in range(n)]
    assert all(len({t[i : i + 5] for i in range(len(t) - 4)}) > 500 for t in texts)
    assert not any(similar(texts[0], other) for other in texts[1:])
    return texts


def test_unlike_long_lines_are_told_apart_in_their_bands(table, monkeypatch):
    """No pair of them is sent anywhere, nor are their shingles."""
    texts = _long_lines(24)
    # one of them has a copy with an edit
    texts.append(texts[3].replace(" ", "#", 1))
    met, names = [], []

    def counted(tables, pairs, lines, name, verify=line_dedup._verified, **options):
        names.extend(tables.names)
        met.append(pairs.count())
        return verify(tables, pairs, lines, name, **options)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    found = rows(line_dedup.remove_similar_lines(table(list(enumerate(texts)))), "doc_id", "n_removed")
    assert [i for i, n in found if n] == [24]
    assert sum(met) == 1 and "line-prefixes" not in names


def test_bands_in_which_all_meet_put_nothing_in_the_driver(table, monkeypatch):
    """The counts of common shingles, a constant of the plan, are for larger bands only."""

    def refused(*_, **__):
        raise AssertionError("a constant was made")

    monkeypatch.setattr(line_dedup.ConstantTable, "of", refused)
    texts = _long_lines(24)
    texts.append(texts[5].replace(" ", "#", 1))
    found = rows(line_dedup.remove_similar_lines(table(list(enumerate(texts)))), "doc_id", "n_removed")
    assert [i for i, n in found if n] == [24]


@pytest.mark.parametrize("size", [8, 20, 4096])
def test_bands_of_any_size_are_searched_wholly(table, monkeypatch, size):
    monkeypatch.setattr(line_dedup, "LARGE_BAND", size)
    rng = random.Random(24)
    opening = "all of this was written by the people who once lived beside the old river and said"
    texts = []
    for i in range(70):
        # every fifth one has no opening
        own = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=90))
        start = opening if i % 5 else "nothing but a few words of its own"
        texts += [f"{start} {own}", f"{start} {own[:45]}#{own[46:]}"]
    found = rows(line_dedup.remove_similar_lines(table(list(enumerate(texts)))), "doc_id", "n_removed")
    pairs = [i for i in range(1, 140, 2) if similar(texts[i - 1], texts[i])]
    assert {i for i, n in found if n} == set(pairs) and len(pairs) > 50


def test_prefixes_of_unlike_lines_make_no_pairs(spark):
    """Sets that share three quarters are told apart by all their parities, before their shared shingles are counted."""
    rng = random.Random(31)

    def letters(size):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size))

    shared = letters(240)
    texts = [shared + letters(80) for _ in range(12)]
    texts.append(texts[0][:150] + "#" + texts[0][151:])
    assert [(a, b) for b in range(13) for a in range(b) if similar(texts[a], texts[b])] == [(0, 12)]
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    sets = lines.select("id", line_dedup._shingles(F.col("line")).alias("shingles"))
    crowd = sets.select("id", F.col("id").alias("part"), F.size("shingles").alias("n"), line_dedup._parities(F.col("shingles")).alias("bits"))
    with Tables(spark) as tables:
        met = line_dedup._prefix_pairs(tables, crowd.select("id", "part", "n", "bits.*"), lines)
        assert rows(met, "a", "b") == [(0, 12)]


def test_pairs_that_links_connect_are_not_compared(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    pairs = spark.createDataFrame([(1, 3), (1, 5), (3, 7), (8, 9), (5, 6)], "a long, b long")
    assert sorted(rows(line_dedup._apart(pairs, links), "a", "b")) == [(1, 5), (3, 7), (8, 9)]


def test_grouped_rows_are_dealt_to_buckets_once(spark):
    """By the shuffle of the grouping: one file a bucket, and nothing is shuffled after it."""
    with Tables(spark) as tables:
        counted = spark.range(1000).groupBy((F.col("id") % 50).alias("k")).agg(F.count("*").alias("n"))
        table = tables.write_bucketed(counted, "counted", 5, "k", grouped=True)
        assert len(table.inputFiles()) <= 5
        again = table.groupBy("k").agg(F.sum("n").alias("n"))
        assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
        assert {(r["k"], r["n"]) for r in again.collect()} == {(k, 20) for k in range(50)}


NAMES = [
    "gone_id", "gone_places", "n_lines", "n_removed", "places", "name", "line", "rate", "rate_id", "_copy", "kept_id",
    "component", "component_id", "kept", "shard", "place", "id", "band",
]


def test_columns_named_like_inner_ones(spark, table):
    docs = table([(1, LINES), (2, LINES), (3, "one two three four five six"), (4, None), (None, "x y"), (None, "x y")], *NAMES)
    kept = line_dedup.remove_similar_lines(docs)
    assert sorted(kept.columns) == sorted(docs.columns)
    assert [n for (n,) in rows(kept.where("doc_id = 2"), "n_removed")] == [2]
    left = corpus_pipeline.drop_lines(spark, docs, "")
    assert left.columns == docs.columns
    assert all(r["n_removed"] == 7 and r["gone_id"] == 7 for r in left.collect())
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert near.columns == docs.columns and {i for (i,) in rows(near, "doc_id")} == {1, 3, 4, None}
    rates = docs.select("doc_id", F.lit(2.0).alias("rate"))
    assert mixing.apply_rates(docs, rates).count() == 2 * docs.count()
    assert mixing.apply_rates(docs, rates).columns == docs.columns


def test_rows_that_share_an_id_or_have_none(table):
    docs = table([(1, "a b"), (1, "c d"), (None, "e"), (None, "f")])
    rates = docs.selectExpr("doc_id", "if(text in ('a b', 'e'), 3.0D, 1.0D) as rate")
    counts = {r["text"]: r["count"] for r in mixing.apply_rates(docs, rates).groupBy("text").count().collect()}
    assert counts == {"a b": 3, "c d": 3, "e": 3, "f": 3}
