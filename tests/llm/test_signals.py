"""Whitening, periodic runs and the quality classifier against brute force."""

import hashlib
import itertools
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from predlens.llm import queries
from predlens.llm.periods import find_runs, runs_of
from predlens.llm.quality import Ftrl, Settings, judge_quality, text_features, train, with_quality
from predlens.llm.recompression import Grammar
from predlens.llm.whitening import LARGEST, whiten

# --- whitening


def whitened_by_hand(vectors, components=32):
    """Covariance and projections from whole numbers, with the constant a million added."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(column) for column in zip(*x)]
    off = np.array([[n * a - s for a, s in zip(row, sums)] for row in x], dtype=object)
    deviation = [sum(d * d for d in row) for row in off]
    centred = np.array([[float(Fraction(int(d), n)) for d in row] for row in off])
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    return deviation, centred @ axes[:, order] / np.sqrt(values[order]), values[order] / np.trace(covariance)


def test_whitening_query(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, expected, explained = whitened_by_hand([r["embedding"] for r in table])
    rows = queries.op11_multiplicity_whitening(spark, data).orderBy("vec_id", "component").collect()
    assert len(rows) == 32 * len(table)
    ours = np.array([r["whitened"] for r in rows]).reshape(-1, 32)
    signs = np.sign((ours * expected).sum(axis=0))
    assert np.allclose(ours * signs, expected, atol=1e-8)
    assert [r["deviation"] for r in rows[::32]] == deviation
    assert {r["n"] for r in rows} == {len(table)}
    assert np.allclose([r["explained"] for r in rows[:32]], explained, rtol=1e-9)
    covariance = np.cov(ours.T, bias=True)
    assert abs(rows[0]["identity_error"] - np.abs(covariance - np.eye(32)).max()) < 1e-10 and rows[0]["identity_error"] < 1e-8


def test_whitening_weighs_repeats(frame):
    random = np.random.default_rng(3)
    vectors = random.normal(size=(40, 5)).astype(np.float32).tolist()
    rows = [(i, v, "kept") for i, v in enumerate(vectors + [vectors[7]] * 3000)]  # far more than one row in HOT
    df = frame(rows, "vec_id long, embedding array<float>, deviation string")
    found, fitted, error = whiten(df)
    deviation, expected, _ = whitened_by_hand([r[1] for r in rows])
    got = sorted(found.collect(), key=lambda r: r["vec_id"])
    ours = np.array([r["whitened"] for r in got])
    assert np.allclose(ours * np.sign((ours * expected).sum(axis=0)), expected, atol=1e-8) and error < 1e-10
    assert [r["deviation"] for r in got] == deviation and fitted.n == 3040
    once, fitted_once, error_once = whiten(df, weights="one")
    _, expected_once, _ = whitened_by_hand(vectors)
    ours = np.array([r["whitened"] for r in sorted(once.collect(), key=lambda r: r["vec_id"])[:40]])
    assert np.allclose(ours * np.sign((ours * expected_once).sum(axis=0)), expected_once, atol=1e-8)
    assert fitted_once.n == 40 and error_once < 1e-10


def test_whitening_edge_cases(frame):
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 2.0, 3.0])]
    good = [(7, [0.5, 1.0]), (None, [0.5, 1.0]), (8, [2.0, -1.0]), (8, [2.0, -1.0]), (9, [0.25, 0.0])]
    found, fitted, error = whiten(frame(bad + good, "vec_id long, embedding array<double>"))
    assert sorted((r["vec_id"] or 0) for r in found.collect()) == [0, 7, 8, 8, 9] and fitted.n == 5 and error < 1e-9
    # A direction without variance is no component, a single vector has none, nor has an empty table.
    flat, fitted, _ = whiten(frame([(1, [1.0, 3.0]), (2, [2.0, 3.0]), (3, [5.0, 3.0])], "vec_id long, embedding array<double>"))
    assert fitted.axes.shape == (2, 1) and flat.count() == 3
    for rows in ([(1, [1.0, 3.0])] * 4, []):
        none, fitted, error = whiten(frame(rows, "vec_id long, embedding array<double>"))
        assert none.count() == 0 and fitted is None and {"deviation", "whitened"} <= set(none.columns)
    # Entries beyond the range are held; deviations beyond 64 bits are NULL.
    big, fitted, _ = whiten(frame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>"))
    assert [r["deviation"] for r in big.orderBy("vec_id").collect()][0] is None and abs(fitted.sums[0]) <= LARGEST


# --- periodic runs


def sequence(random, size, letters):
    out = []
    while len(out) < size:
        piece = list(random.integers(0, letters, random.integers(1, 15)))
        out += piece * int(random.choice([1, 1, 3, 8]))
    return np.array(out[:size], np.int64)


def agreement(s, i, j, way):
    n = 0
    while s[i] == s[j]:
        i, j, n = i + way, j + way, n + 1
    return n


def test_grammar_extensions():
    random = np.random.default_rng(0)
    for letters in (1, 2, 4, 30):
        for _ in range(25):
            s = np.concatenate([[100], sequence(random, random.integers(2, 150), letters), [101]])
            grammar = Grammar(s)
            x, y = random.integers(1, len(s) - 1, (2, 100))
            x, y = x[x != y], y[x != y]
            for way in (1, -1):
                assert grammar.agreement(x, y, way).tolist() == [agreement(s, i, j, way) for i, j in zip(x, y)]


def runs_by_hand(words, least=24, times=3):
    """Every stretch on which words agree one period on, for every period."""
    found = {}
    for p in range(1, len(words) // times + 1):
        edges = np.diff(np.concatenate([[0], (words[:-p] == words[p:]).astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            if b - a + p >= max(least, times * p):
                found.setdefault((a, b - a + p), p)
    return sorted(((a, size, p) for (a, size), p in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (2, 2), (30, 5)])
def test_runs(least, times):
    random = np.random.default_rng(least)
    for letters in (1, 2, 5, 50):
        for _ in range(10):
            texts = [sequence(random, random.integers(0, 500), letters) for _ in range(random.integers(1, 7))]
            for text, found in zip(texts, runs_of(texts, least, times)):
                assert list(map(tuple, found.tolist())) == runs_by_hand(text, least, times)


def test_runs_of_neighbouring_texts():
    """Words that agree across the border of two texts make no run, nor do they disturb others."""
    random = np.random.default_rng(9)
    common = random.integers(0, 1000, 40)
    texts = [np.concatenate([common[:12], random.integers(0, 1000, 80 + k), common[:12]]) for k in range(40)]
    texts += [np.concatenate([common, np.tile([5, 6, 7], 20)]), np.tile(common[:9], 5)]
    for order in (texts, texts[::-1], texts[1::2] + texts[::2], texts[:40]):
        for text, found in zip(order, runs_of(order)):
            assert list(map(tuple, found.tolist())) == runs_by_hand(text)


def test_grammar_shrinks():
    words = np.random.default_rng(5).integers(0, 1000, 100_000)
    grammar = Grammar(np.concatenate([[1000], words, [1001]]))
    assert sum(len(level.symbols) for level in grammar.levels) < 8 * len(words)
    same = Grammar(np.concatenate([[1], np.zeros(100_000, np.int64), [2]]))
    assert len(same.levels) < 5


def planted(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_runs_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    found = {r["doc_id"]: r for r in queries.op12_recompression_runs(spark, data).collect()}
    assert len(found) == len(docs) and any(r["n_runs"] > 0 for r in found.values())
    for doc in docs:
        words, row = planted(doc["doc_id"], doc["text"]), found[doc["doc_id"]]
        codes = {}
        runs = runs_by_hand(np.array([codes.setdefault(w, len(codes)) for w in words], np.int64))
        dropped = {i for start, size, p in runs for i in range(start + p, start + size)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        assert row["n_runs"] == len(runs) and (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()


def test_runs_edge_cases(frame):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "é ü " * 40, "z"), (3, "a b c " * 30_000 + "end", None), (4, "\t \n", "w")]
    df = frame(rows, "doc_id long, text string, runs string")
    found = find_runs(df).collect()
    assert len(found) == 6
    for row in found:
        runs = [tuple(r) for r in row["runs"]]
        if row["doc_id"] is None:
            assert runs == [(0, 40, 1)] and row["collapsed"] == "é ü"
        elif row["doc_id"] == 3:
            assert runs == [(0, 90_000, 3)] and row["collapsed"] == "a b c end" and row["n_words"] == 90_001
        else:
            assert not runs and row["collapsed"] == "" and row["n_words"] == 0
    assert find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        find_runs(df, times=1)


# --- quality


def test_features_count_ngrams():
    settings = Settings(shapes=(), bits=30)
    for text in ("a b c a b", "one", "x x x x", "é ü é ü ö"):
        buckets, values = text_features(text.encode(), settings)
        words = text.split(" ")
        grams = [list(zip(*[words[i:] for i in range(size)])) for size in (1, 2)]
        assert len(buckets) == sum(len(set(g)) for g in grams)
        expected = sorted(np.sqrt(g.count(one) / len(g)) for g in grams for one in set(g))
        assert np.allclose(sorted(values), expected)
    shapes = Settings(words=(), shapes=(1,), bits=30)
    count = lambda text: len(text_features(text.encode(), shapes)[0])
    assert count("one two three") == 1 and count("One two") == 2 and count("ONE!! TWO!! É!!") == 2
    assert count("été one être") == 1 and count("one one one") == 2  # a word again is another shape
    assert len(text_features(b"", settings)[0]) == len(text_features(b" \n\t", settings)[0]) == 0


def test_ftrl_equals_plain_updates():
    """The published update, coordinate by coordinate, on dense vectors."""
    settings, random = Settings(bits=3, alpha=0.7, beta=1.0, l1=0.05, l2=0.3), np.random.default_rng(2)
    learner, z, n = Ftrl(settings), np.zeros(9), np.zeros(9)

    def plain(i):
        l1, l2 = (settings.l1, settings.l2) if i < 8 else (0.0, 0.0)
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((settings.beta + np.sqrt(n[i])) / settings.alpha + l2)

    for _ in range(60):
        at = np.sort(random.choice(8, 3, replace=False)).astype(np.uint32)
        x, label = random.random(3), int(random.integers(0, 2))
        row = [*zip(at.tolist(), x.tolist()), (8, 1.0)]
        w = {i: plain(i) for i, _ in row}
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in row)))
        for i, v in row:
            g = (p - label) * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / settings.alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
        learner.learn(at, x, label)
        assert np.allclose(learner.z, z) and np.allclose(learner.n, n)
    assert np.allclose(learner.weights(), [plain(i) for i in range(9)])


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = queries.op13_ftrl_quality(spark, folder)
    assert found.count() == docs.count()
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all((r["score"] >= 0.7) == r["predicted"] for r in rows)
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([a > b for a, b in itertools.product(good, bad)]) > 0.98
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_held_out_labels_are_not_learned(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (train(docs, labels).weights == train(docs, turned).weights).all()


def test_quality_edge_cases(spark, data, frame):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = train(docs, labels)
    rows = [(1, None), (2, ""), (3, " \t"), (4, "some text here"), (4, "some text here"), (None, "word " * 100_000)]
    df = frame([(*r, "s", "l") for r in rows], "doc_id long, text string, score string, lang string")
    found = with_quality(df, model).collect()
    assert len(found) == 6 and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (1, 2, 3)}) == 1 and len({r["score"] for r in found if r["doc_id"] == 4}) == 1
    nothing = judge_quality(df.select("doc_id", "text"), labels.limit(0)).collect()
    assert len(nothing) == 6 and {(r["score"], r["predicted"]) for r in nothing} == {(0.5, 0)}
    assert judge_quality(df.limit(0), labels).count() == 0
    # Repeated ids, several labels and texts of an id, NULL labels and ids: learned from once, the smallest of each.
    mixed = frame([(4, 1), (4, 0), (4, None), (None, 1), (1, 1), (1, 1)], "doc_id long, quality int")
    clashing = frame([(4, "b"), (4, "a"), (4, "a"), (1, None), (None, "c")], "doc_id long, text string")
    plain = train(frame([(4, "a"), (1, "")], "doc_id long, text string"), frame([(4, 0), (1, 1)], "doc_id long, quality int"))
    assert (train(clashing, mixed).weights == plain.weights).all()
