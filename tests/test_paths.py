"""Ways with derivation against enumeration."""

import random

import pytest

from weirflow.graph import paths as P


def every_way(edges, start):
    kinds, rank = list(P.KINDS), {}
    for a, b, k in edges:
        i = kinds.index(k) if k in kinds else len(kinds) - 1
        rank[a, b] = min(i, rank.get((a, b), i))
    out, todo = [], [((s,), 0, 1.0) for s in start]
    while todo:
        p, k, c = todo.pop()
        for (a, b), i in rank.items():
            if a == p[-1] and b not in p:
                way = ((*p, b), max(k, i), c * P.KINDS[kinds[i]])
                out.append(way)
                todo.append(way)
    return out, kinds


@pytest.mark.parametrize("k", [1, 3, 100])
def test_first_ways_of_an_acyclic_graph(spark, k):
    rng = random.Random(k)
    edges = [(f"n{a}", f"n{b}", rng.choice([*P.KINDS, "other", None])) for a, b in (sorted(rng.sample(range(9), 2)) for _ in range(26))]
    all_, kinds = every_way(edges, ["n0", "n1"])
    want = []
    for ends in {(p[0], p[-1]) for p, _, _ in all_}:
        own = sorted((w for w in all_ if (w[0][0], w[0][-1]) == ends), key=lambda w: (len(w[0]), w[0]))[:k]
        want += [(ends[0], ends[1], len(p) - 1, ">".join(p), kinds[i], round(c, 6)) for p, i, c in own]
    df = spark.createDataFrame([*edges, (None, "n1", "coarse")], "source string, target string, kind string")
    got = P.ways(df, spark.createDataFrame([("n0",), ("n1",), ("n1",), (None,)], "node string"), k)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_cycles_end(spark):
    df = spark.createDataFrame([("a", "b", "passthrough"), ("b", "c", "expression"), ("c", "a", "coarse"), ("b", "b", "coarse"), ("c", "d", "passthrough")], "source string, target string, kind string")
    got = P.ways(df, spark.createDataFrame([("a",)], "node string"))
    assert sorted(map(tuple, got.collect())) == [("a", "b", 1, "a>b", "passthrough", 1.0), ("a", "c", 2, "a>b>c", "expression", 0.9), ("a", "d", 3, "a>b>c>d", "expression", 0.9)]
    assert P.ways(df, spark.createDataFrame([("z",)], "node string")).count() == 0
    assert P.ways(df, spark.createDataFrame([("a",)], "node string"), deepest=1).count() == 1
