"""The corpus pipeline against a brute-force version of its stages, and on odd tables."""

import hashlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from predlens.llm.langid import predictor, train
from predlens.llm.queries import vocabulary_path
from predlens.llm.substrings import Chunking, chunk_digests, chunk_ends, passages
from predlens.session import durable

np = pytest.importorskip("numpy")
tokenizers = pytest.importorskip("tokenizers")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, data):
    """Every stage's result, the documents first."""
    found = [spark.read.parquet(f"{data}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        found.append(durable(stage(spark, found[-1], data), name))
    return found


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_stages_and_columns(stages):
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "source_mix", "bpe"]
    assert all(frame.columns == COLUMNS for frame in stages[:-1])


def test_language_stage(stages):
    docs = stages[0].collect()
    languages, _ = predictor(train(stages[0]))([r["text"] for r in docs])
    assert rows(stages[1]) == sorted((tuple(r) for r, lang in zip(docs, languages) if lang != "und"), key=str)


def test_languages_fill_gaps_and_cost_no_text(frame, spark):
    said = {"en": "the cat and the dog are here with all of them", "fr": "le chat et les chiens sont ici avec nous tous"}
    docs = [(i, said[lang], lang if i < 60 else None) for i in range(80) for lang in [("en", "fr")[i % 2]]] + [(99, "12 34", None)]
    kind = "doc_id long, text string, lang string"
    found = {r["doc_id"]: r["lang"] for r in pipeline.identified(spark, frame(docs, kind), None).collect()}
    assert found == {i: ("en", "fr")[i % 2] for i in range(80)}
    bare = [(i, text, None) for i, text, _ in docs]
    assert rows(pipeline.identified(spark, frame(bare, kind), None)) == sorted(bare[:-1], key=str)


def grams(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_jaccard_stage(stages):
    docs = {r["doc_id"]: r for r in stages[1].collect()}
    sets = {d: grams(r["text"]) for d, r in docs.items()}
    top = {d: d for d in docs}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                top[high] = low
    assert rows(stages[2]) == sorted((tuple(docs[d]) for d in {root(d) for d in docs}), key=str)


def test_substring_stage(stages):
    chunking, owner, parts = Chunking(), {}, {}
    docs = sorted(stages[2].collect(), key=lambda r: r["doc_id"])
    for r in docs:
        raw = r["text"].encode()
        data = np.frombuffer(raw, np.uint8)
        ends = chunk_ends(data, chunking, chunking.gear())
        parts[r["doc_id"]] = raw, data, ends, chunk_digests(raw, ends)
        for digest in parts[r["doc_id"]][3].tolist():
            owner.setdefault(digest, r["doc_id"])
    wanted = []
    for r in docs:
        raw, data, ends, digests = parts[r["doc_id"]]
        foreign = np.array([d for d in digests.tolist() if owner[d] != r["doc_id"]], np.int64)
        gone = passages(data, ends, digests, foreign, chunking.words)
        text = b"".join(raw[a:b] for a, b in zip([0, *[e for _, e in gone]], [*[s for s, _ in gone], len(raw)])).decode()
        wanted.append((r["doc_id"], text, r["lang"], r["source"], len(text) if gone else r["n_chars"]))
    assert rows(stages[3]) == sorted(wanted, key=str)


def test_mix_stage(stages):
    before = {r["doc_id"]: r for r in stages[3].collect()}
    copies = Counter(r["doc_id"] for r in stages[4].collect())
    size = {d: len(r["text"].split()) for d, r in before.items()}
    source_size, taken = defaultdict(int), defaultdict(int)
    for d, r in before.items():
        source_size[r["source"]] += size[d]
        taken[r["source"]] += size[d] * copies[d]
    names = sorted(source_size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    level = sum(source_size.values()) / sum(weight.values())
    assert all(3 * source_size[s] >= level * weight[s] for s in names)
    assert max(copies.values()) <= 3 and all(tuple(r) == tuple(before[r["doc_id"]]) for r in stages[4].collect())
    assert all(abs(taken[s] - level * weight[s]) <= max(size.values()) for s in names)


def test_token_stage(stages):
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    wanted = []
    for r in stages[4].collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        digests = [hashlib.sha256(part.encode()).hexdigest() for part in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        wanted.append((r["doc_id"], r["lang"], r["source"], ids, len(ids), *digests))
    assert rows(stages[5]) == sorted(wanted, key=str)


def test_run_is_the_stages(spark, data, stages):
    assert rows(pipeline.run(spark, data)) == rows(stages[-1])


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_odd_tables(frame, spark, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, removed int, class string, size string, `a.b` int"
    extra = (7, "c", "d", 5)
    odd = [
        (1, None, None, None, None, None, *extra), (2, "", "en", "s", 0, None, *extra), (3, "the one text", "en", None, 12, None, *extra),
        (3, "the one text", "en", None, 12, None, *extra), (None, "another é text", None, "s", 14, None, *extra), (4, "z " * 50_000, "fr", "t", 100_000, None, *extra),
    ]
    docs = frame(odd, schema)
    done = stage(spark, docs, None)
    if name != "bpe":
        assert done.columns == docs.columns
        assert all(r["removed"] == 7 and r["a.b"] == 5 for r in done.collect())
    assert done.count() > 0
    assert stage(spark, docs.limit(0), None).count() == 0
