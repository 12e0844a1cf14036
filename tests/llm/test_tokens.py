"""BPE against the tokenizers library, language identification on held-out documents."""

import hashlib
import random

import numpy as np
import pytest

from predlens.llm import queries
from predlens.llm.bpe import Tokenizer, decode_ids, encode_texts
from predlens.llm.langid import ByteCnn, Settings, held_out, identify_languages, predictor, train, with_language

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def path():
    return queries.vocabulary_path()


@pytest.fixture(scope="module")
def library(path):
    return tokenizers.Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def ours(path):
    return Tokenizer.read(path)


def same(ours, library, text):
    ids = ours.encode(text).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_mixed_characters(ours, library):
    random.seed(3)
    letters = "".join(map(chr, [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x4E00, 0x1F600, 0x85, 0x180E, 0x660]))
    for _ in range(400):
        same(ours, library, "".join(random.choice(letters if random.random() < 0.5 else "aeio tnsr\n'") for _ in range(random.choice([1, 5, 60, 400]))))


@pytest.mark.parametrize("unit", ["a", "ab", "aaab", "the", " ", "\n", "-=", "hehe", "é", "😀", "1"])
def test_long_pieces_stream(ours, library, unit):
    for times in (1, 40, 333, 5000):
        same(ours, library, unit * times + "x")


def test_long_word_of_random_letters(ours, library):
    random.seed(4)
    same(ours, library, "".join(random.choice("etaoinshrdlu") for _ in range(20_000)))


def test_stream_keeps_a_window(ours):
    """Tokens come out while symbols still go in."""
    fed = 0

    def symbols():
        nonlocal fed
        for _ in range(50_000):
            fed += 1
            yield ours.byte[ord("a")]

    merges = ours.merges
    taken = 0
    for token in merges.stream(symbols()):
        taken += merges.sizes[token]
        assert fed - taken <= merges.reach + 2 * merges.step
    assert taken == 50_000


def test_broken_characters_and_added_tokens(ours, library):
    same(ours, library, "a<|endoftext|>b <|endoftext|><|endoftext|> c")
    half = ours.encode("é").tolist()
    assert ours.decode([ours.byte[0xC3]]) == library.decode([ours.byte[0xC3]], skip_special_tokens=False)
    assert ours.decode(half) == "é"


def test_frame_edge_cases(frame, path, library):
    rows = [(1, "", "x"), (2, None, "y"), (2, None, "y"), (None, "word " * 9000, "z"), (3, "é" * 700, None)]
    df = frame(rows, "doc_id long, text string, token_ids string")
    coded = decode_ids(encode_texts(df, path), path).collect()
    assert len(coded) == 5
    for row in coded:
        assert row["token_ids"] == library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["decoded"] == (row["text"] or "")
    assert encode_texts(df.limit(0), path).count() == 0


def test_query_digests(spark, data, library):
    found = {r["doc_id"]: r for r in queries.op7_streaming_bpe(spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(found) == len(rows)
    for row in rows:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        mine = found[row["doc_id"]]
        assert mine["n_tokens"] == len(ids)
        assert mine["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify_languages(docs).withColumnRenamed("doc_id", "id")
    rows = docs.join(found, docs.doc_id == found.id).where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(spark, frame):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    network = train(docs, Settings(epochs=2, per_language=20))
    rows = [(1, None), (2, ""), (3, "1234 %% 5"), (4, "the thing of the and"), (4, "the thing of the and"), (5, "ü " * 60_000)]
    df = frame([(*r, 0.5, "q") for r in rows], "doc_id long, text string, score double, lang_pred string")
    found = with_language(df, network).collect()
    assert len(found) == 6
    for row in found:
        blank = row["doc_id"] in (1, 2, 3)
        assert (row["lang_pred"] == "und") == blank and (row["score"] == 0) == blank
    assert len({(r["lang_pred"], r["score"]) for r in found if r["doc_id"] == 4}) == 1
    unlabelled = frame([(1, "some text", None, 2), (None, "other text", "en", 3)], "doc_id long, text string, lang string, held_out int")
    assert {(r["lang_pred"], r["held_out"]) for r in identify_languages(unlabelled).collect()} == {("und", False)}
    assert identify_languages(unlabelled.limit(0)).count() == 0


def test_scores_do_not_depend_on_the_batch(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    predict = predictor(train(docs, Settings(epochs=1, per_language=10)))
    texts = [f"{'the thing of ' * (i % 40)}und der {i}" for i in range(150)]
    alone = [[column[0] for column in predict([text])] for text in texts]
    for first in (0, 1, 7, 64):
        for step in (1, 3, 50):
            together = predict(texts[first::step])
            assert [list(pair) for pair in zip(*together)] == alone[first::step]


def test_folded_tables_equal_a_plain_convolution(spark):
    network = ByteCnn(["a", "b"], Settings(window=20, filters=3, embedding=4))
    windows = np.random.default_rng(0).integers(0, 256, (5, 20)).astype(np.uint8)
    w, plain = network.weights, []
    for window in windows:
        vectors = [w["embedding"][byte] for byte in window]
        pooled = []
        for width in (2, 3, 4):
            responses = [np.concatenate(vectors[i : i + width]) @ w[f"filter{width}"] + w[f"bias{width}"] for i in range(20 - width + 1)]
            pooled += [max(0.0, max(r[f] for r in responses)) for f in range(3)]
        raw = np.array(pooled) @ w["out"] + w["out_bias"]
        plain.append(np.exp(raw) / np.exp(raw).sum())
    assert np.allclose(network.scorer()(windows), plain, atol=1e-5)


def test_gradient_equals_finite_differences():
    network = ByteCnn(["a", "b", "c"], Settings(window=12, filters=2, embedding=3))
    random = np.random.default_rng(1)
    windows, wanted = random.integers(0, 256, (4, 12)).astype(np.uint8), np.array([0, 2, 1, 1])

    def loss():
        w, total = network.weights, 0.0
        for window, label in zip(windows, wanted):
            vectors, pooled = w["embedding"][window], []
            for width in (2, 3, 4):
                responses = np.array([vectors[i : i + width].ravel() @ w[f"filter{width}"] + w[f"bias{width}"] for i in range(12 - width + 1)])
                pooled.append(np.maximum(responses.max(axis=0), 0))
            raw = np.concatenate(pooled) @ w["out"] + w["out_bias"]
            total += np.log(np.exp(raw).sum()) - raw[label]
        return total / len(windows)

    gradient = network.loss_gradient(windows, wanted)
    for name, g in gradient.items():
        flat = network.weights[name].reshape(-1)
        for i in random.choice(len(flat), min(20, len(flat)), replace=False):
            held = flat[i]
            flat[i] = held + 1e-6
            up = loss()
            flat[i] = held - 1e-6
            down = loss()
            flat[i] = held
            assert abs((up - down) / 2e-6 - g.reshape(-1)[i]) < 1e-5


def test_held_out_rule(frame):
    import zlib

    rows = frame([(i,) for i in range(200)], "doc_id long").select("doc_id", held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
