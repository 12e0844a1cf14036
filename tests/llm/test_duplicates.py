"""Pairs, chunks and components against brute force, with NULLs, ties, repeats and clashing names."""

import random

import numpy as np
import pytest

from predlens.llm.components import components
from predlens.llm.linking import roots_of
from predlens.llm.minhash import Banding, link_documents, one_per_group, shared_counts
from predlens.llm.mtree import MTree, top_k
from predlens.llm.pivots import PivotIndex, link_vectors, list_names
from predlens.llm.shingles import shingles
from predlens.llm.substrings import Chunking, chunk_ends, dedup_substrings, rolling_hash, word_starts

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def grams(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def reachable(nodes, pairs):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components_of_paths_stars_and_rings(frame):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)]
    edges += [(rng.randrange(5000, 5100), rng.randrange(5000, 5100)) for _ in range(70)]
    rng.shuffle(edges)
    wanted = reachable({n for e in edges if e[0] != e[1] for n in e}, edges)
    found = {r["node"]: r["component"] for r in components(frame(edges, "a long, b long")).collect()}
    assert found == wanted
    assert components(frame(edges, "a long, b long").limit(0)).count() == 0


def test_roots_of_a_long_path():
    order = np.random.default_rng(2).permutation(300)
    assert (roots_of(300, order[:-1], order[1:]) == 0).all()


def test_shingles_and_shared_counts():
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([1, 4, 5, 6, 40, 300])) for _ in range(30)]
    texts += [edited(rng, t, 1) for t in texts] + ["a\tb\n c  d", "a b c d", "é ü"]
    sets = [shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(grams(t)) for t in texts]
    assert (sets[-3] == sets[-2]).all()
    everyone = np.arange(len(sets))
    counts = shared_counts(sets, everyone, everyone)
    assert all(counts[i, j] == len(grams(texts[i]) & grams(texts[j])) for i in everyone for j in everyone if i != j)
    assert len(shingles(None)) == len(shingles("")) == len(shingles(" \n\t")) == 0


def test_bands_reach_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        banding = Banding(recall=recall)
        assert 1 - (1 - 0.8**banding.rows) ** banding.bands >= recall > 1 - (1 - 0.8**banding.rows) ** (banding.bands - 1)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows, doc = [], 0
    base = prose(rng, 150)
    texts = [base] * 40 + [edited(rng, base, rng.choice([1, 2, 3, 5, 8])) for _ in range(150)]
    texts += [prose(rng, rng.choice([1, 3, 30, 200])) for _ in range(60)]
    texts += ["", None, " \n", "one two", "one  two\n", "x" * 50_000, "long " * 30_000]
    rng.shuffle(texts)
    for text in texts:
        rows.append((doc, text, "s", "c"))
        doc += 1
    return rows


SCHEMA = "doc_id long, text string, number string, class string"


def test_jaccard_links_match_brute_force(frame, corpus):
    sets = {d: grams(t) for d, t, *_ in corpus}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    links, wanted = dict.fromkeys(sets, 0), reachable(sets, pairs)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    found = {r["doc_id"]: r for r in link_documents(frame(corpus, SCHEMA), Banding(block=16)).collect()}
    assert {d: r["n_links"] for d, r in found.items()} == links
    assert {d: r["component_id"] for d, r in found.items()} == wanted
    assert all(r["kept"] == (d == wanted[d]) for d, r in found.items())
    kept = one_per_group(frame(corpus, SCHEMA))
    assert kept.columns == ["doc_id", "text", "number", "class"]
    assert {r["doc_id"] for r in kept.collect()} == set(wanted.values())


def test_jaccard_odd_ids(frame):
    text = " ".join(WORDS[:50])
    near = text.replace("w25 ", "q ")
    rows = [(None, text, "", ""), (None, text, "", ""), (7, near, "", ""), (7, near, "", ""), (7, "quite another text", "", ""), (None, None, "", ""), (3, None, "", ""), (3, None, "", "")]
    docs = frame(rows, SCHEMA)
    found = sorted((r["doc_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in link_documents(docs, Banding(recall=0.999999)).collect())
    assert found == [(0, 0, 0, True), (0, 3, 7, False), (0, 3, 7, False), (3, 0, 3, True), (3, 0, 3, True), (7, 0, 7, True), (7, 3, 7, True), (7, 3, 7, True)]
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in one_per_group(docs, Banding(recall=0.999999)).collect())
    assert kept == sorted([(0, ""), (3, ""), (3, ""), (7, near), (7, "quite another text")])
    assert link_documents(docs.limit(0)).count() == 0 and one_per_group(docs.limit(0)).count() == 0


def test_rolling_hash_is_the_recurrence():
    data = np.random.default_rng(6).integers(0, 256, 500, dtype=np.uint8)
    gear = Chunking().gear()
    h, slow = 0, []
    for byte in data:
        h = (2 * h + int(gear[byte])) % 2**16
        slow.append(h)
    assert rolling_hash(data, gear).tolist() == slow


def test_chunks_resist_insertions():
    rng = random.Random(7)
    text = prose(rng, 600)
    chunking = Chunking()

    def chunks(t):
        data = t.encode()
        ends = chunk_ends(np.frombuffer(data, np.uint8), chunking, chunking.gear())
        assert ends[-1] == len(data)
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    before, after = chunks(text), chunks("some words put in front " + text[:900] + " and in between " + text[900:])
    assert len(set(before) - set(after)) <= 4
    assert chunks("x" * 100) == [b"x" * 100] or len(chunks("x" * 100)) > 1


def test_repeated_passages_are_cut(frame):
    rng = random.Random(8)
    passage = prose(rng, 60)
    rows = []
    for i in range(120):
        clean = prose(rng, rng.choice([5, 80, 300]))
        rows.append((i, f"{clean}\n{passage}\n{prose(rng, 30)}" if i % 4 == 0 else clean, [i], "x"))
    found = {r["doc_id"]: r for r in dedup_substrings(frame(rows, "doc_id long, text string, removed array<int>, id string")).collect()}
    assert len(found) == 120
    for i, text, *_ in rows:
        row = found[i]
        cut = "".join(text[a:b] for a, b in zip([0, *[s["end"] for s in row["removed"]]], [*[s["start"] for s in row["removed"]], len(text)]))
        assert row["text"] == cut and row["id"] == "x"
        if i % 4 or i == 0:
            assert row["text"] == text and row["removed"] == []
        else:
            assert len(row["removed"]) == 1 and len(text.split()) - len(row["text"].split()) >= 30
            assert set(grams(row["text"])) & set(grams(passage)) != set(grams(passage))


def test_phrases_of_many_documents_are_no_passage(frame):
    rng = random.Random(12)
    made = prose(rng, 200)
    data = made.encode()
    ends = chunk_ends(np.frombuffer(data, np.uint8), Chunking(), Chunking().gear()).tolist()
    chunks = [data[a:b].decode() for a, b in zip([0, *ends], ends)]
    rows = [(i, f"{chunk}and {prose(rng, 3)}") for i, chunk in enumerate(chunks)]  # every chunk stands alone in a document
    rows += [(1000, made), (1001, f"{prose(rng, 30)}\n{made}")]
    found = {r["doc_id"]: r for r in dedup_substrings(frame(rows, "doc_id long, text string")).collect()}
    assert found[1000]["text"] == made and found[1000]["removed"] == []
    assert len(found[1001]["text"].split()) < 60


def test_passages_are_cut_to_their_last_chunk(frame):
    rng = random.Random(13)
    for n in (20, 21, 25, 40, 77):
        text = prose(rng, n)
        found = {r["doc_id"]: r["text"] for r in dedup_substrings(frame([(1, text), (2, text)], "doc_id long, text string")).collect()}
        assert found == {1: text, 2: ""}


@pytest.mark.parametrize("first, last, size", [(0x4E00, 0x9FA0, 300), (0x3041, 0x3090, 300), (0x0E01, 0x0E2F, 500), (0x4E00, 0x9FA0, 4000)])
def test_passages_in_scripts_without_spaces(frame, first, last, size):
    rng = random.Random(14)

    def written(n):
        return "".join(chr(rng.randrange(first, last)) for _ in range(n))

    passage = written(size)
    rows = [(1, written(400) + passage + written(90)), (2, written(250) + passage + written(700)), (3, written(900)), (4, passage[:30] + written(300))]
    found = {r["doc_id"]: r["text"] for r in dedup_substrings(frame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == rows[i - 1][1] for i in (1, 3, 4))
    assert 950 <= len(found[2]) <= 950 + 160
    spaced = f"a {'x' * 40} b".encode()  # a long word of a spaced text is one
    assert word_starts(np.frombuffer(spaced, np.uint8))[-1] == 3 * 3


def test_substring_edge_cases(frame):
    rng = random.Random(9)
    passage, other = prose(rng, 100), prose(rng, 100)
    rows = [
        (1, None), (2, ""), (2, ""), (3, passage), (3, passage), (None, passage), (None, passage), (5, f"{other} {other}"),
        (6, "é" * 40_000), (7, "é" * 40_000), (8, " \n "), (9, f"{passage}　{'漢字' * 300}"),
    ]
    found = dedup_substrings(frame(rows, "doc_id long, text string")).collect()
    texts = {}
    for row in found:
        texts.setdefault(row["doc_id"], []).append(row["text"])
    assert texts[1] == [None] and texts[2] == ["", ""] and texts[8] == [" \n "]
    assert texts[3][0] != texts[3][1] and passage in texts[3] and len(min(texts[3])) < len(passage) / 3
    assert all(len(t) < len(passage) / 3 for t in texts[None])
    assert len(texts[5][0]) < 1.2 * len(other) + 60
    assert len(found) == len(rows)
    assert dedup_substrings(frame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_repeats_of_rows_without_an_id_of_their_own(frame):
    """A passage that stands in rows with a NULL id, or with one and the same, stays in one of them."""
    rng = random.Random(15)
    passage, shared = prose(rng, 80), prose(rng, 80)
    rows = [(None, f"{prose(rng, 60)}\n{passage}\n{prose(rng, 30)}", i) for i in range(20)]
    rows += [(7, f"{prose(rng, 60)}\n{shared}\n{prose(rng, 30)}", 100 + i) for i in range(20)] + [(8, shared, 200), (5, passage, 201)]
    rows += [(None, rows[0][1], 300)] * 3
    found = dedup_substrings(frame(rows, "doc_id long, text string, hash int")).collect()
    assert len(found) == len(rows)
    assert [r["hash"] for r in found if passage in r["text"]] == [201]
    assert [r["doc_id"] for r in found if shared in r["text"]] == [7]
    whole = {r[2]: r[1] for r in rows}
    assert sum(r["text"] == whole[r["hash"]] for r in found) == 2 and all(len(r["text"].split()) < 115 for r in found if r["doc_id"] == 7 and shared not in r["text"])
    copies = [r["text"] for r in found if r["hash"] in (0, 300)]
    assert len(copies) == 4 and sum(len(text.split()) > 60 for text in copies) == 1


def vectors_of(rng, groups, alone, dimension=24):
    rows = []
    for size, cosine in groups:
        centre = rng.normal(size=dimension)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            noise = rng.normal(size=dimension)
            noise -= noise @ centre * centre
            noise /= np.linalg.norm(noise)
            rows.append(rng.uniform(0.5, 3) * (cosine * centre + np.sqrt(1 - cosine**2) * noise))
    rows += list(rng.normal(size=(alone, dimension)))
    return [[float(x) for x in row] for row in rows]


def test_vector_links_have_recall(frame):
    rng = np.random.default_rng(10)
    vectors = vectors_of(rng, [(120, 0.985), (30, 0.97), (2, 0.98), (2, 0.98), (60, 0.96)], 400)
    vectors += [vectors[0]] * 5
    rows = [(i, v, "l", 1) for i, v in enumerate(vectors)]
    found = {r["vec_id"]: r for r in link_vectors(frame(rows, "vec_id long, embedding array<double>, class string, number int"), PivotIndex(block=32)).collect()}
    units = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = units @ units.T >= 0.9
    np.fill_diagonal(close, False)
    n_links = np.array([found[i]["n_links"] for i in range(len(rows))])
    assert (n_links <= close.sum(1)).all()
    assert n_links.sum() >= 0.97 * close.sum()
    assert all(found[len(rows) - 1 - k]["component_id"] == found[0]["component_id"] for k in range(5))
    assert all(r["kept"] == (r["component_id"] == i) for i, r in found.items())


@pytest.mark.parametrize("common", [0.0, 0.3, 0.55, 0.8, 0.88])
def test_vector_links_have_recall_off_the_centre(frame, common):
    """Vectors with a common direction, as those of texts have: ``common`` is their mean cosine."""
    rng = np.random.default_rng(31)
    size, dimension = 1500, 32
    rows = rng.normal(size=(size, dimension))
    rows[size // 2 :] = rows[: size // 2] + 0.45 * rng.normal(size=(size - size // 2, dimension)) / (1 - common)  # pairs near the threshold
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    units = np.sqrt(1 - common) * rows + np.sqrt(common) * np.eye(dimension)[0]
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    table = frame([(i, v.tolist()) for i, v in enumerate(units)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in link_vectors(table).collect()}
    close = units @ units.T >= 0.9
    np.fill_diagonal(close, False)
    n_links = np.array([found[i] for i in range(size)])
    assert close.sum() > 100 and (n_links <= close.sum(1)).all()
    assert n_links.sum() >= 0.93 * close.sum()


def test_pivots_do_not_collapse(frame):
    from predlens.llm.pivots import describe

    rng = np.random.default_rng(32)
    for common, fewest in ((0.5, 200), (0.86, 1)):  # where nearly all are alike, one list of all is the cheapest for so few
        units = np.sqrt(1 - common) * rng.normal(size=(3000, 64)) / 8 + np.sqrt(common) * np.eye(64)[0]
        found = describe(frame([(i, v.tolist()) for i, v in enumerate(units)], "id long, embedding array<double>"), PivotIndex(), 64)
        assert len(found.pivots) >= fewest and found.recall >= 0.95


@pytest.mark.parametrize("pivots", [64, 512, 1024, 2048, 4096])
def test_pairs_at_the_threshold_meet_for_any_number_of_pivots(pivots):
    rng = np.random.default_rng(15)

    def units(n):
        rows = rng.normal(size=(n, 64))
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)

    index, one, points = PivotIndex(), units(800), units(pivots)
    other = rng.normal(size=one.shape)
    other -= (other * one).sum(1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    other = index.threshold * one + np.sqrt(1 - index.threshold**2) * other
    lists = [list_names(side, points, index)[1] for side in (one, other)]
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(*lists)]) >= 0.93


def test_vector_edge_cases(frame):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]),
        (8, [2e30, 0.0]), (9, [1.0]), (None, [3.0, 0.0]), (10, [0.0, -1e-30]),
    ]
    vectors = frame(rows, "vec_id long, embedding array<float>")
    found = {}
    for row in link_vectors(vectors).collect():
        found.setdefault(row["vec_id"], set()).add((row["n_links"], row["component_id"], row["kept"]))
    assert found == {
        **{i: {(0, i, True)} for i in (1, 2, 3, 4, 5, 6, 10)}, 7: {(4, 7, True)}, 8: {(4, 7, False)}, 9: {(4, 7, False)}, None: {(4, 7, False)},
    }
    assert link_vectors(vectors.limit(0)).count() == 0
    assert link_vectors(vectors.where("vec_id < 7")).count() == 6


def best_by_scan(vectors, k, scale=64):
    whole = {i: [int(x) for x in np.floor(scale * np.asarray(v, float))] for i, v in vectors.items()}
    found = {}
    for q in whole:
        if q % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q]
            found[q] = [(c, -s) for s, c in sorted(scores)[:k]]
    return found


@pytest.mark.parametrize("kind", ["spread", "grouped", "ties", "huge"])
def test_top_k_is_exact(frame, kind):
    rng = np.random.default_rng(11)
    rows = {
        "spread": rng.normal(size=(700, 6)),
        "grouped": np.repeat(rng.normal(size=(7, 6)), 100, axis=0) + 0.01 * rng.normal(size=(700, 6)),
        "ties": rng.integers(-1, 2, size=(700, 3)) / 4,
        "huge": rng.normal(size=(100, 5)) * 1e6,
    }[kind]
    vectors = {i: [float(x) for x in v] for i, v in enumerate(rows)}
    table = frame([(i, v, 0, 0) for i, v in vectors.items()], "vec_id long, embedding array<double>, rank int, block int")
    found = {}
    for row in sorted(top_k(table, tree=MTree(block=256, page=16, batch=8)).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    assert found == best_by_scan(vectors, 20)


def test_top_k_leaves_out_pages():
    """Grouped vectors need few of the products."""
    from predlens.llm import mtree
    import pandas as pd

    rng = np.random.default_rng(12)
    vectors = np.floor(64 * (np.repeat(10 * rng.normal(size=(40, 8)), 100, axis=0) + 0.01 * rng.normal(size=(4000, 8))))
    pages = pd.DataFrame([{k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in p.items()} for p in mtree.pages_of(np.arange(4000), vectors, MTree(page=50))])
    search, seen = mtree.Search(pages, 8), []
    keys = search._keys
    search._keys = lambda queries, page, part: seen.append(len(queries) * (part.stop - part.start)) or keys(queries, page, part)
    search.best(np.arange(0, 4000, 40), vectors[::40], 5)
    assert sum(seen) < 0.25 * 100 * 4000


def test_top_k_edge_cases(frame):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [1.5, 2.0]), (20, None), (40, [nan, 1.0]), (60, [None, 1.0]), (80, []), (None, [9.0, 9.0]), (1, [1.0])]
    table = frame(rows, "vec_id long, embedding array<float>")
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(table).collect())
    # Each of the three rows of id 0 is a query, and a candidate for the other two.
    equal = [(0, 1, 0, 22528), (0, 2, 0, 20480), (0, 3, 1, 4096), (0, 4, 80, 0)]
    other = [(0, 1, 0, 22528), (0, 2, 0, 22528), (0, 3, 1, 6144), (0, 4, 80, 0)]
    empty = [(80, 1, 0, 0), (80, 2, 0, 0), (80, 3, 0, 0), (80, 4, 1, 0)]
    assert found == sorted(equal + equal + other + empty)
    assert top_k(table.limit(0)).count() == 0
    assert {(r["rank"], r["vec_id"]) for r in top_k(table.where("vec_id = 0")).collect()} == {(1, 0), (2, 0)}


def test_top_k_of_repeated_ids_equals_the_sql(spark, frame, tmp_path):
    import duckdb
    from oracle import compare

    from predlens.llm.checks import TOP_K_SQL

    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 60)), rng.normal(size=4).tolist()) for _ in range(300)]
    rows += [(30, [100.0, 0.0, 0.0, 0.0]), (30, [-5.0, 2.0, 0.0, 0.0]), (20, [1.0, 0.0, 0.0, 0.0])] + [(40, [1.0, 1.0, 1.0, 1.0])] * 30
    table = frame(rows, "vec_id long, embedding array<float>")
    table.write.parquet(str(tmp_path / "embeddings"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings/*.parquet'")
    for block in (64, 16384):
        equal, message = compare(top_k(table, tree=MTree(block=block, page=16)), connection, TOP_K_SQL)
        assert equal, message
