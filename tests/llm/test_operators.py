"""The training-data operators against brute-force versions on small tables with awkward rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from glyphgraph.llm import ann, bpe, exact, line_dedup, mixing, partenum, quality, secret_scan, substring, suffix
from glyphgraph.llm.catalogue import find_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, found string, bucket int"


@pytest.fixture(scope="module")
def table(spark):
    """documents from (doc_id, text) rows, with extra columns whose names the operators use inside."""
    find_package(spark)

    def make(rows):
        full = [(i, t, "en", "src0", len(t or ""), 1, "x", 2) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


def awkward(seed, alphabet="ab", words=40):
    rng = random.Random(seed)
    texts = [" ".join("".join(rng.choices(alphabet, k=2)) for _ in range(rng.randrange(words))) for _ in range(40)]
    texts += [None, "", " \n\t", texts[0], texts[0], texts[1] + " tail", "é😀 " * 30, "x" * 5000]
    return list(enumerate(texts))


def rows(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_windows(table, seed):
    docs, window = awkward(seed), 3
    first = {}
    for i, text in docs:
        words = (text or "").split()
        for j in range(len(words) - window + 1):
            first.setdefault(tuple(words[j : j + window]), i)
    expected = []
    for i, text in docs:
        words = (text or "").split()
        gone = set()
        for j in range(len(words) - window + 1):
            if first[tuple(words[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        expected.append((i, len(words), len(gone), kept))
    found = substring.remove_repeats(table(docs), window=window)
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_text") == sorted(expected, key=repr)


@pytest.mark.parametrize("seed", [3, 4])
def test_repeated_bytes(table, seed):
    docs, length = awkward(seed), 12
    data = [(i, (t or "").encode()) for i, t in docs]
    counts = Counter(b[j : j + length] for _, b in data for j in range(len(b) - length + 1))
    expected = []
    for i, b in data:
        gone = {k for j in range(len(b) - length + 1) if counts[b[j : j + length]] > 1 for k in range(j, j + length)}
        expected.append((i, len(b), len(gone), bytearray(x for k, x in enumerate(b) if k not in gone)))
    found = suffix.remove_repeated_bytes(table(docs), length=length, gram=4)
    assert rows(found, "doc_id", "n_bytes", "n_removed", "kept") == sorted(expected, key=repr)


def test_ngram_components(table):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    docs = [(0, None), (1, ""), (2, "a B"), (3, "A b"), (4, " ".join(base))]
    for i in range(5, 60):
        words = list(base)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
        docs.append((i, " ".join(words)))
    sets = {}
    for i, text in docs:
        words = (text or "").lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i, _ in docs}
    changed = True
    while changed:
        changed = False
        for i in root:
            for j in root:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 80 * len(sets[i] | sets[j]) and root[j] < root[i]:
                    root[i], changed = root[j], True
    found = partenum.ngram_components(table(docs))
    assert rows(found, "doc_id", "n_shingles", "component_id") == sorted(((i, len(sets[i]), root[i]) for i in sets), key=repr)


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(0)
    for size in [1, 2, 3, 5, 8, 13, 40, 100, 333, 1000]:
        for _ in range(10):
            a = rng.integers(0, 2**62, size).astype(np.uint64)
            drop = rng.integers(0, int(size * 0.2) + 1)
            for b in (a[drop:], np.concatenate([a[drop // 2 :], rng.integers(0, 2**62, drop // 4).astype(np.uint64)])):
                both = len(np.intersect1d(a, b))
                if 100 * both < 80 * (len(a) + len(b) - both):
                    continue
                hashes = np.concatenate([np.sort(a), np.sort(b)])
                edges = np.array([0, len(a), len(a) + len(b)])
                made, owner = partenum.signatures(hashes, edges, np.sort(a[:3]))
                assert set(made[owner == 0].tolist()) & set(made[owner == 1].tolist())


def test_exact_groups(table):
    docs = [(5, "a b"), (3, "ab"), (4, "a\n b "), (9, None), (8, ""), (7, " "), (1, "c"), (2, "a b")]
    found = exact.exact_groups(table(docs), capacity=1)
    assert rows(found, "doc_id", "keep_id", "group_size", "kept") == [
        (1, 1, 1, True), (2, 4, 4, False), (3, 4, 4, False), (4, 4, 4, True), (5, 4, 4, False),
        (7, 7, 3, True), (8, 7, 3, False), (9, 7, 3, False),
    ]
    assert exact.exact_groups(table([])).count() == 0


def test_secrets(table):
    key = "AKIA" + "ABCDEFGH12345678"
    docs = [(1, f"é password = 'hunter22x' {key}"), (2, "token: short"), (3, None), (4, "f" * 40), (5, "API_KEY=" + "Z" * 9)]
    found = secret_scan.find_secrets(table(docs)).select("doc_id", secret_scan.written(secret_scan.F.col("secrets")).alias("s"))
    assert rows(found, "doc_id", "s") == [
        (1, "assign:2:23,access:25:45"), (2, ""), (3, ""), (4, "hex:0:40"), (5, "assign:0:17"),
    ]


def test_trigram_queries():
    assert secret_scan.trigram_query("AKIA[A-Z0-9]{12,}") == [frozenset({"aki", "kia"})]
    assert secret_scan.trigram_query("[0-9a-f]{32,}") is None
    assert secret_scan.trigram_query("x(abc|abcd)?") is None


def test_line_dedup(table):
    line = "the quick brown fox jumps over the lazy dog near the river bank again and again"
    docs = [(1, f"{line}\n\nother line here"), (2, f"{line}!\nfresh"), (3, None), (4, ""), (5, line), (6, "other line here")]
    found = rows(line_dedup.remove_similar_lines(table(docs)), "doc_id", "text", "n_removed")
    assert found == [
        (1, f"{line}\n\nother line here", 0), (2, "fresh", 1), (3, None, 0), (4, "", 0), (5, "", 1), (6, "", 1),
    ]


def test_pipeline_drops_copies_with_blank_lines(spark, table):
    import corpus_pipeline

    text = "one line of the text\n\n\nanother line of it\n \t\nthe last line here"
    docs = [(1, text), (2, text), (3, text), (4, f"{text}\nand one more line"), (5, None), (6, "\n\n")]
    left = rows(corpus_pipeline.drop_lines(spark, table(docs), ""), "doc_id", "text")
    assert [i for i, _ in left] == [1, 4, 5, 6]
    assert left[1][1].split() == ["and", "one", "more", "line"]


def _edited(rng, alphabet, length):
    text = rng.choices(alphabet, k=length)
    other = list(text)
    other[rng.randrange(length)] = "#"
    return "".join(text), "".join(other)


def test_similar_lines_link(table):
    rng = random.Random(11)
    chinese = [chr(0x4E00 + i) for i in range(2000)]
    pairs = [_edited(rng, chinese, n) for n in (60, 120) * 20]
    for n in range(20):
        text = "".join(rng.choices(chinese, k=60))
        pairs.append((text, f"1.{text}"))
    # unlike lines that share opening and close
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(300)]
    for _ in range(40):
        text = "read more about this: " + " ".join(rng.choices(words, k=8)) + " - all rights reserved"
        place = rng.randrange(25, 70)
        pairs.append((text, text[:place] + "#" + text[place + 1 :]))
    pairs += [("-" * 10, "-" * 30), ("abcdefghij", "abcdefghijk")]
    docs = [(2 * i + k, line) for i, pair in enumerate(pairs) for k, line in enumerate(pair)]
    gone = {i for i, n in rows(line_dedup.remove_similar_lines(table(docs)), "doc_id", "n_removed") if n}
    assert all(i % 2 for i in gone)
    missed = [i for i in range(len(pairs)) if 2 * i + 1 not in gone]
    assert len(missed) <= 2


def test_mixing_meets_targets(spark, table):
    docs = [(i, f"red {i} apple" if i % 4 else f"blue {i} sea") for i in range(80)] + [(99, None)]
    frame = table(docs)
    labelled = frame.selectExpr("doc_id", "text", "if(text like 'red%', 'r', 'b') as domain").where("doc_id < 60")
    rates = mixing.fit_rates(frame, labelled, {"r": 0.5, "b": 0.5})
    got = [rates.selectExpr(f"sum(rate * n_tokens * posteriors[{i}])").first()[0] for i in range(2)]
    assert got[0] == pytest.approx(got[1], rel=1e-4)
    assert rates.selectExpr("min(rate)").first()[0] >= 0
    assert mixing.fit_rates(frame, labelled.where("false"), {"r": 1.0}).where("rate <> 1").count() == 0


def test_mixing_knows_texts_of_rare_words(spark, table):
    rng = random.Random(4)
    vocabulary = {d: ["".join(rng.choices("abcdefgh", k=6)) for _ in range(150)] for d in "rb"}
    docs = [(i, "\t".join(rng.choices(vocabulary["rb"[i % 2]], k=4))) for i in range(900)] + [(1000, None), (1001, "unseen0")]
    frame = table(docs)
    labelled = frame.selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'r', 'b') as domain").where("doc_id < 600")
    rates = mixing.fit_rates(frame, labelled, {"r": 0.5, "b": 0.5})
    found = dict(rows(rates, "doc_id", "posteriors"))
    assert len(found) == len(docs)
    assert sum(found[i][i % 2 == 0] > 0.9 for i in range(600, 900)) >= 295
    assert found[1000] == pytest.approx([0.5, 0.5]) and found[1001] == pytest.approx([0.5, 0.5])


def test_quality_on_held_out_rows(spark, table):
    rng = random.Random(8)
    common = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(400):
        words = rng.choices(common, k=50)
        if i % 4 == 0:
            words[::10] = [rng.choice(["junk", "spam", "trash"]) for _ in words[::10]]
        docs.append((i, " ".join(words)))
    docs += [(1000, None), (1001, "")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, bad int")
    found = quality.score_quality(table(docs), labels)
    kept = dict(rows(found, "doc_id", "kept"))
    assert all(kept[i] == (i % 4 != 0) for i in range(200, 400))
    assert kept[1000] and kept[1001]


def test_quality_learns_rare_words(spark, table):
    rng = random.Random(9)
    common, rare = [f"w{i}" for i in range(200)], ["".join(rng.choices("abcdefghijklm", k=9)) for _ in range(50)]
    docs = []
    for i in range(600):
        words = rng.choices(common, k=40)
        if i % 4 == 0:
            words[::14] = rng.sample(rare, 3)
        docs.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, bad int")
    kept = dict(rows(quality.score_quality(table(docs), labels), "doc_id", "kept"))
    # each word is in some six of the bad documents fitted on
    assert sum(kept[i] for i in range(400, 600, 4)) <= 2
    assert sum(not kept[i] for i in range(400, 600) if i % 4) <= 2


def test_neighbours(spark):
    find_package(spark)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    x[40:60] = x[40]
    vectors = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    vectors += [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (None, [1.0] * 8)]
    found = defaultdict(list)
    for q, rank, i, score in rows(ann.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), neighbours=5), "query_id", "rank", "vec_id", "score"):
        found[q].append((rank, i, score))
    hits = 0
    for q in range(0, 300, 20):
        score = x @ x[q]
        best = [int(i) for i in np.lexsort((np.arange(300), -score)) if i != q][:5]
        hits += len(set(best) & {i for _, i, _ in found[q]})
        assert [r for r, _, _ in sorted(found[q])] == [1, 2, 3, 4, 5]
    assert set(found) == set(range(0, 300, 20))
    assert hits >= 0.9 * 75


def test_automaton_spells_as_merging_does():
    labels = {0: b"a", 1: b"b", 2: b"ab", 3: b"aa", 4: b"aab", 5: b"bab"}
    merges = [(0, 1, 2), (0, 0, 3), (0, 2, 4), (1, 2, 5)]
    automaton = bpe.MergeAutomaton(labels, merges)
    rng = random.Random(9)
    for _ in range(500):
        word = bytes(rng.choices(b"ab", k=rng.randrange(1, 14)))
        tokens = [0 if c == 97 else 1 for c in word]
        for u, v, w in merges:
            i = 0
            while i + 1 < len(tokens):
                if tokens[i : i + 2] == [u, v]:
                    tokens[i : i + 2] = [w]
                i += 1
        assert automaton.encode(word) == tokens


def test_tokenizer_agrees_with_the_library(table):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = [(1, None), (2, ""), (3, "It's the  <|endoftext|> naïve 😀\n\n 123"), (4, "aa" * 300), (5, "\x1c\x85 x\xa0y")]
    for row in bpe.encode_texts(table(docs), path, outputs=("ids", "decoded", "ids_sha256")).collect():
        text = dict(docs)[row["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(row["ids"]) == ids and row["decoded"] == text
        code = b"".join(i.to_bytes(4, "little") for i in ids)
        assert row["ids_sha256"] == hashlib.sha256(code).hexdigest()


def test_empty_tables(spark, table):
    empty = table([])
    labels = spark.createDataFrame([], "doc_id long, bad int")
    assert substring.remove_repeats(empty).count() == 0
    assert suffix.remove_repeated_bytes(empty).count() == 0
    assert partenum.ngram_components(empty).count() == 0
    assert secret_scan.find_secrets(empty).count() == 0
    assert line_dedup.remove_similar_lines(empty).count() == 0
    assert quality.score_quality(empty, labels).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_chunks_bound_the_text_of_a_slice():
    from glyphgraph.llm.arrays import chunks

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 50, "z"])], ["text"])
    assert [c.num_rows for c in chunks([batch], chunk_bytes=20)] == [2, 1, 1]
