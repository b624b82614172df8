"""Keys and references found from rows against all sets and all pairs of columns."""

import random
from itertools import combinations

from weirflow.quality import keys as D


def brute_keys(data, names, largest):
    found = []
    for size in range(1, largest + 1):
        for s in combinations(range(len(names)), size):
            own = [tuple(r[i] for i in s) for r in data]
            if own and not any(None in o for o in own) and len(set(own)) == len(own) and not any(set(k) <= set(s) for k in found):
                found.append(s)
    return [tuple(names[i] for i in s) for s in found]


def test_keys_of_up_to_three_columns(spark):
    rng = random.Random(5)
    for n, wide in ((40, 4), (60, 8), (25, 3)):
        data = [(i // 2, rng.randrange(wide), rng.choice("abc"), float(rng.randrange(wide)), rng.choice([None, i])) for i in range(n)]
        df = spark.createDataFrame(data, "a int, b int, `c c` string, d double, e int")
        for sample in (3, 10_000):
            assert D.keys(df, 3, sample=sample) == brute_keys(data, df.columns, 3)
    rows = spark.createDataFrame([(1, "x", [1, 2]), (2, "x", [1, None])], "k int, v string, l array<int>")
    assert D.keys(rows, 2) == [("k",), ("l",)]
    assert D.keys(rows.limit(0)) == [] and D.keys(rows.select("v")) == []
    assert D.keys(spark.createDataFrame([(None,), (1,)], "k int")) == []


def test_values_that_lie_in_other_columns(spark):
    rng = random.Random(6)
    tables, values = {}, {}
    for t in range(4):
        data = [tuple(rng.choice([None, rng.randrange(3 + 3 * c)]) for c in range(20)) for _ in range(30)]
        tables[f"t{t}"] = spark.createDataFrame(data, ", ".join(f"c{c} {'int' if t % 2 else 'bigint'}" for c in range(20)))
        values |= {(f"t{t}", f"c{c}"): {r[c] for r in data} - {None} for c in range(20)}
    assert len(values) > D.WORD  # more columns than a word has bits
    assert D.included(tables) == {a: {b for b in values if b != a and values[a] <= values[b]} for a in values}
    odd = {"x": spark.createDataFrame([("1", 1, None)], "s string, i int, n int"), "y": spark.createDataFrame([(1, "1", 2.0)], "k bigint, s string, d double")}
    assert D.references(odd) == [("x", "i", "y", "k"), ("x", "s", "y", "s"), ("y", "k", "x", "i"), ("y", "s", "x", "s")]
    assert D.included({"z": odd["x"].limit(0)}) == {}


def test_hashes_find_what_values_do(spark):
    df = spark.range(600).selectExpr("id", "id div 2 as a", "cast(id % 7 as double) as d", "cast(id % 300 as string) as s", "array(id % 150) as l")
    sets = list(combinations(df.columns, 2))
    want = D._repeats(df, sets)
    assert D._repeats_by_hash(df, sets, 1) == want and len(want) in range(1, len(sets))
    assert D._repeats_by_hash(df, sets, 8) <= want
