"""SimHash near-duplicates against every two fingerprints compared."""

import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from weirflow.llm import simhash


def printed(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, ids, radius=3):
    """Component of each row by comparing every two different prints."""
    own = sorted(set(prints))
    p = np.array(own, np.uint64)
    a, b = np.nonzero(np.bitwise_count(p[:, None] ^ p[None]) <= radius)
    root = simhash.least_reached(len(p), iter([(a, b)]))
    of = {x: root[i] for i, x in enumerate(own)}
    least = {}
    for x, i in zip(prints, ids, strict=True):
        if i is not None:
            least[of[x]] = min(i, least.get(of[x], i))
    return [least.get(of[x]) for x in prints]


@pytest.mark.parametrize("piece", [3, 50, 1 << 20])
def test_fingerprints(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["A", "bé", "C\x85d", "e", "　f"]) + rng.choice(["", "x\t", "\n \r"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += ["", " ", "a", "a b", "a b c ", "  A b C d", "x " * 3000]
    assert [int(x) for x in simhash.fingerprints_of([t.encode() for t in texts])] == [printed(t) for t in texts]


@pytest.mark.parametrize("pairs", [64, 1 << 21])
def test_trees_find_all_within_the_radius(monkeypatch, pairs):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = np.random.default_rng(0)
    p = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    p = np.unique(np.r_[p, p[:200] ^ np.uint64(5), p[:100] ^ np.uint64(1 << 40 | 7)])
    tree = np.sort(rng.integers(0, 3, len(p)))
    trees, roots = simhash.build(p, tree)
    parents = trees.edges // 65
    assert (np.bitwise_count(p[parents] ^ p[trees.nodes]) == trees.edges % 65).all()
    assert len(set(trees.edges.tolist())) == len(trees.edges) == len(p) - 3
    for radius in (0, 3, 7):
        got = {(int(x), int(y)) for a, b in simhash.search(trees, p, roots, radius) for x, y in zip(a, b, strict=True)}
        near = (np.bitwise_count(p[:, None] ^ p[None]) <= radius) & (tree[:, None] == tree[None])
        assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))


@pytest.mark.parametrize(("blocks", "tree"), [(4, 4096), (5, 4096), (4, 8), (6, 5)])
def test_forest(spark, blocks, tree):
    """One family of prints that share most shards, chains, and others; with small trees the large shards' are broadcast."""
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    made = [base]
    for _ in range(4):
        made.append(made[-1] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)))
    family = base[0] ^ (np.uint64(1) << rng.integers(0, 24, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 24, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 24, 150).astype(np.uint64))
    prints = np.unique(np.concatenate([*made, family]))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print bigint")
    edges = simhash.forest(df, blocks=blocks, tree=tree, together=3).collect()
    of = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]) <= 3)
    want = simhash.least_reached(len(prints), iter([(a, b)]))
    got = simhash.least_reached(len(prints), iter([(np.array([of[r["a"]] for r in edges]), np.array([of[r["b"]] for r in edges]))]))
    assert got.tolist() == want.tolist()
    assert len(set(want.tolist())) < len(prints) - 100


def test_near_duplicates(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(300)]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            words = list(words)
            words[rng.randrange(300)] = "other"
            texts.append(" ".join(words))
    texts += [None, "", " \n", "a", "A", "a", "lorem ipsum dolor " * 50_000, "lorem ipsum dolor " * 50_001]
    ids = [7 * i % 1000 for i in range(len(texts))]
    ids[3], ids[4], ids[5] = None, ids[0], ids[0]
    rows = [(i, t, "p", 1, "r") for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, print string, least int, root string").repartition(5)
    want = sorted((str(i), f"{p:016x}", str(c)) for i, p, c in zip(ids, map(printed, texts), classes([printed(t) for t in texts], ids), strict=True))
    for tree in (4096, 4):
        got = simhash.near_duplicates(df, tree=tree)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted((str(r[0]), r[1], str(r[2])) for r in got.collect()) == want
    assert len({c for _, _, c in want}) < len(want) - 20


def test_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    alone = spark.createDataFrame([(None, "one two three four")], "doc_id bigint, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(alone).collect()] == [None]
