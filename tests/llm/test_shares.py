"""Sharding and mixing: their laws, and the operators on odd rows."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from predlens.llm.mixing import mix_documents, mixed_rows, source_targets
from predlens.llm.running import running_total
from predlens.llm.sharding import Shard, Tree, shard_documents, with_shard


def shards(df, tree):
    return {r["doc_id"]: r["shard"] for r in with_shard(df, "doc_id", tree).collect()}


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(20_000).withColumnRenamed("id", "doc_id")


def test_grown_tree_moves_rows_to_the_new_shard_only(ids):
    tree = Tree.even(8)
    for _ in range(3):
        before, after = shards(ids, tree), shards(ids, tree.grown())
        moved = {k for k in before if before[k] != after[k]}
        assert {after[k] for k in moved} == {len(tree.shards)}
        assert len(moved) == pytest.approx(20_000 / (len(tree.shards) + 1), rel=0.1)
        tree = tree.grown()


def test_shares_follow_weights_and_movement_stays_in_the_subtree(ids):
    tree = Tree((Shard("a", "a1", 0, 1), Shard("a", "a1", 1, 2), Shard("a", "a2", 2, 1), Shard("b", "b1", 3, 4), Shard("b", "b1", 4, 0)))
    before = shards(ids, tree)
    counts = Counter(before.values())
    assert set(counts) == {0, 1, 2, 3}
    assert all(counts[s.number] == pytest.approx(20_000 * s.weight / 8, rel=0.07) for s in tree.shards if s.weight)
    swapped = Tree((Shard("a", "a1", 0, 2), Shard("a", "a1", 1, 1), *tree.shards[2:]))
    after = shards(ids, swapped)
    assert all({before[k], after[k]} == {0, 1} for k in before if before[k] != after[k])
    with pytest.raises(ValueError):
        with_shard(ids, "doc_id", Tree(()))


def test_shard_rows(frame):
    rows = [(i % 50 if i % 3 else None, "é" * i if i % 7 else None, i, "x") for i in range(400)]
    found = shard_documents(frame(rows, "doc_id long, text string, shard int, size string"), Tree.even(8)).collect()
    assert len(found) == 400
    slots = defaultdict(list)
    for row in found:
        slots[row["shard"]].append(row["slot"])
        assert row["grown_shard"] in (row["shard"], 8) and row["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in found if r["doc_id"] is None}) == 1
    assert {(r["size"], r["text_crc32"]) for r in found if r["text_crc32"] is None} == {(1, None)}
    assert shard_documents(frame(rows, "doc_id long, text string, a int, b string").limit(0), Tree.even(8)).count() == 0


def test_running_total_of_one_group(frame):
    rows = [(0, i % 5, 1) for i in range(500)] + [(1, None, 3), (1, 2, 4)]
    found = running_total(frame(rows, "g int, o int, v long"), "g", [F.col("o")], "v").collect()
    assert sorted(r["before"] for r in found if r["g"] == 0) == list(range(500))
    assert {(r["o"], r["before"]) for r in found if r["g"] == 1} == {(None, 0), (2, 3)}


def fill(sizes, weights=(5, 2, 1)):
    """Water filling, one capped source after the other."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_weight = sum(w for s, w in weight.items() if s not in capped)
        left = total - sum(capped.values())
        over = {s: 3.0 * sizes[s] for s in names if s not in capped and open_weight and left * weight[s] / open_weight > 3 * sizes[s]}
        if not over:
            return {s: capped.get(s, left * weight[s] / open_weight if open_weight else 0.0) for s in names}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, None: 10, "d": 3, "e": 0}, {"x": 0}, {"a": 10**12, "b": 1, "c": 5}])
def test_targets(frame, sizes):
    table = frame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in source_targets(table).collect()}
    assert found == pytest.approx(fill(sizes))


def corpus():
    rows = []
    for i in range(600):
        source = "big" if i % 3 == 0 else [None, "small", "mid", "é"][i % 4] if i % 5 else "rare"
        rows.append((i, "w " * (i * 37 % 90), source, 0))
    return rows + [(1, None, "mid", 0), (2, "", "big", 0), (None, "a b c", "mid", 0), (None, "a b c", "mid", 0), (700, "x y\x1cz", "blank", 0)]


SCHEMA = "doc_id long, text string, source string, size int"


def test_mix_reaches_targets(frame):
    rows = corpus()
    found = mix_documents(frame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    largest = max(r["size"] for r in found)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in found:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) and r["taken"] == r["copies"] * r["size"]
    assert target == pytest.approx(fill(size))
    assert all(r["source_size"] == size[r["source"]] for r in found)
    assert all(abs(taken[s] - target[s]) <= largest for s in target)
    assert sum(size.values()) - largest < sum(taken.values()) <= sum(size.values())
    again = mix_documents(frame(rows, SCHEMA).repartition(7)).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in again) == Counter((r["doc_id"], r["size"], r["taken"]) for r in found)
    mixed = mixed_rows(frame(rows, SCHEMA))
    assert mixed.columns == ["doc_id", "text", "source", "size"]
    copies = Counter()
    for r in found:
        copies[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    counted = Counter((r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in mixed.collect())
    assert counted == Counter({k: n for k, n in copies.items() if n})


def test_mix_of_odd_tables(frame):
    rows = corpus()
    assert mix_documents(frame(rows, SCHEMA).limit(0)).count() == 0 and mixed_rows(frame(rows, SCHEMA).limit(0)).count() == 0
    empty = frame([(1, "", "a", 0), (2, None, None, 0)], SCHEMA)
    assert {r["taken"] for r in mix_documents(empty).collect()} == {0} and mixed_rows(empty).count() == 0
    single = mix_documents(frame([(1, "one giant document here", "a", 0)], SCHEMA)).collect()
    assert [(r["size"], r["taken"]) for r in single] == [(4, 4)]
