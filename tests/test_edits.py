"""Texts within an edit distance against all pairs."""

import random

import pytest

from weirflow.operators import edits as E


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def texts(rng, n):
    base = ["Customer#" + "".join(rng.choice("012") for _ in range(rng.randrange(2, 7))) for _ in range(n)]
    other = ["".join(rng.choice("ab|é") for _ in range(rng.randrange(7))) for _ in range(n)]
    return [None, "", *base, *other, *base[:3]]


@pytest.mark.parametrize("most", [0, 1, 2])
@pytest.mark.parametrize("hot", [2_000, 8])
def test_equals_all_pairs(spark, most, hot):
    rng = random.Random(10 * most + hot)
    a, b = texts(rng, 45), texts(rng, 40)
    l = spark.createDataFrame(list(enumerate(a)), "i int, s string")  # noqa: E741
    r = spark.createDataFrame(list(enumerate(b)), "j int, t string")
    want = sorted((i, j, distance(x, y)) for i, x in enumerate(a) for j, y in enumerate(b) if x is not None and y is not None and distance(x, y) <= most)
    got = E.similar_rows(l, r, "s", "t", most, hot)
    assert sorted((q["i"], q["j"], q["distance"]) for q in got.collect()) == want
    assert len(want) > 3


def test_odd_calls(spark):
    df = spark.createDataFrame([("a",)], "text string")
    assert E.similar_texts(df.limit(0), df, 1).count() == 0
    assert [tuple(r) for r in E.similar_texts(df, df, 3).collect()] == [("a", "a", 0)]
    with pytest.raises(ValueError):
        E.similar_texts(df, df, -1)
    with pytest.raises(ValueError):
        E.similar_rows(df, df, "text", "text", 1)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_one_beginning(spark, most):
    """Rests of hot segments: short ones, and ones too long to be listed with their deletions."""
    rng = random.Random(most)
    tails = ["".join(rng.choice("01") for _ in range(rng.choice([2, 5, 6, 40]))) for _ in range(20)]
    own = sorted({"Customer#000" + x for t in tails for x in (t, t[1:], t[:3] + "1" + t[4:], t + "0")})
    df = spark.createDataFrame([(t,) for t in own], "text string")
    want = sorted((a, b, distance(a, b)) for a in own for b in own if distance(a, b) <= most)
    assert sorted(tuple(q) for q in E.similar_texts(df, df, most, hot=3).collect()) == want


def test_rows_of_one_name_are_no_edits(spark, tmp_path):
    from weirflow.queries.registry import QUERIES

    spark.createDataFrame([(1, "Customer#1"), (2, "Customer#1"), (3, "Customer#2")], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    assert sorted(tuple(r) for r in QUERIES["edits_customers"](spark, str(tmp_path)).collect()) == [(1, 3, 1), (2, 3, 1)]
