"""Declared orders, running values by ranges and joins by bins, on cases that the tables do not hold."""

import collections
import datetime
import itertools
import random
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirflow.operators import aggregates as A
from weirflow.operators import bands as B
from weirflow.operators import joins as J
from weirflow.operators import rows as R
from weirflow.operators.order import asc, desc, order, rank_key
from weirflow.operators.scan import scan


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_orders_are_read(spark):
    assert [(o.descending, o.nulls_lead) for o in map(order, ("a", "a desc", "a DESC NULLS FIRST", "lower(a)  asc nulls last", desc("a"), asc("a", "last"), desc("b desc", "first"), F.col("x")))] == [
        (False, True), (True, False), (True, True), (False, False), (True, False), (False, False), (True, True), (False, True),
    ]
    assert order("desc").expr == "desc" and order("a.desc").expr == "a.desc"
    assert order("x desc").reversed() == order("x asc nulls first")
    for bad in (F.desc("a"), F.col("a").asc_nulls_last()):
        with pytest.raises(ValueError, match="direction"):
            order(bad)
    with pytest.raises(ValueError):
        desc("a", "middle")
    with pytest.raises(ValueError):
        order("")


VALUES = {
    "string": [None, "", "a", "ab", "a\x00", "é", "b", "日本"],
    "binary": [None, b"", b"\x00", b"\xff", b"a", b"ab"],
    "bigint": [None, -(2**63), -1, 0, 7, 2**63 - 1],
    "double": [None, float("-inf"), -1.5, 0.0, 3.0, float("inf"), float("nan")],
    "decimal(10,2)": [None, Decimal("-3.10"), Decimal("0.00"), Decimal("5.25")],
    "boolean": [None, True, False],
    "date": [None, datetime.date(1900, 1, 1), datetime.date(1970, 1, 1), datetime.date(2024, 2, 29)],
    "timestamp": [None, datetime.datetime(1960, 1, 1, 1), datetime.datetime(2024, 1, 1)],
    "timestamp_ntz": [None, datetime.datetime(1960, 1, 1, 1), datetime.datetime(2024, 1, 1, 0, 0, 0, 1)],
}


@pytest.mark.parametrize("kind", VALUES)
def test_rank_keys_sort_as_the_order_does(spark, kind):
    df = spark.createDataFrame([(v,) for v in VALUES[kind]], f"v {kind}").coalesce(1)
    for way in ("v", "v desc", "v desc nulls first", "v asc nulls last"):
        want = [r["v"] for r in df.orderBy(order(way).sort()).collect()]
        got = [r["v"] for r in df.orderBy(rank_key(df, [way])).collect()]
        assert repr(got) == repr(want)


def test_arrays_have_no_descending_key(spark):
    df = spark.createDataFrame([([1],)], "v array<int>")
    assert rank_key(df, ["v"]) is not None
    with pytest.raises(ValueError, match="descending"):
        rank_key(df, ["v desc"])


def test_every_operator_takes_descending_text(spark):
    df = spark.createDataFrame([(1, "a"), (1, "c"), (1, None), (1, "b"), (2, None)], "k int, v string")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    for by in ("v desc", desc("v")):
        assert rows(A.top(df, 1, [by], ["k"])) == [(1, "c"), (2, None)]
        assert rows(A.first_row(df, ["k"], [by])) == [(1, "c"), (2, None)]
        assert rows(A.first_row(df, ["k"], [by], descending=True)) == [(1, None), (2, None)]
        assert rows(J.lookup(keys, df, [("k", "k")], {"w": "v"}, "first", [by])) == [(1, "c"), (2, None), (3, None)]
        assert rows(J.top_per_row(keys, df, [("k", "k")], [by], 2, {"w": "v"})) == [(1, "b"), (1, "c"), (2, None)]
        assert rows(J.dynamic_lookup(df, keys.limit(0).withColumn("v", F.lit("")), ["k"], [by], ["v"])[1]) == [(1, "c"), (2, None)]
        assert {(r["v"], r["s"]) for r in A.sequence(df.where("k = 1"), "s", by).collect()} == {("c", 1), ("b", 2), ("a", 3), (None, 4)}
        assert [r["v"] for r in R.first_rows(df, 9, [by]).collect()][:2] == ["c", "b"]
    assert rows(A.top(df, 1, ["v desc nulls first"], ["k"])) == [(1, None), (2, None)]
    assert [r["m"] for r in A.moving(df.where("k = 1 and v is not null"), ["k"], ["v desc"], 2, {"m": ("max", "v")}).orderBy("v").collect()] == ["b", "c", "c"]
    for call in (lambda by: A.top(df, 1, [by]), lambda by: A.first_row(df, ["k"], [by]), lambda by: J.lookup(keys, df, [("k", "k")], {"w": "v"}, "first", [by])):
        with pytest.raises(ValueError, match="direction"):
            call(F.desc("v"))


def test_dynamic_lookup_adds_one_of_equal_rows(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 5, "x"), (1, 5, "y"), (1, 6, "z"), (None, 1, "n"), (None, 1, "n"), (2, 1, None)], "k int, o int, v string")
    held = spark.createDataFrame([(2, "h")], "k int, v string")
    seen, table = J.dynamic_lookup(df, held, ["k"], ["o"], ["v"])
    assert rows(seen.select("k", "o", "v", "new_lookup_row")) == rows(spark.createDataFrame([(1, 5, "x", 1), (1, 5, "x", 0), (1, 5, "x", 0), (1, 6, "x", 0), (None, 1, "n", 1), (None, 1, "n", 0), (2, 1, "h", 0)], "k int, o int, v string, f int"))
    assert rows(table) == [(1, "x"), (2, "h"), (None, "n")]


# Running values


def folded(data, key, by):
    """(row, total, count, least, greatest, last, previous, number) by one pass."""
    out = []
    for _, own in itertools.groupby(sorted(data, key=lambda r: (repr(key(r)), by(r))), key=lambda r: repr(key(r))):
        seen, before = [], None
        for n, r in enumerate(own, 1):
            if r[2] is not None:
                seen.append(r[2])
            out.append((*r, sum(seen) if seen else None, len(seen), min(seen, default=None), max(seen, default=None), seen[-1] if seen else None, before, n))
            before = r[2]
    return sorted(out, key=repr)


PORTS = {"total": ("sum", "v"), "n": ("count", "v"), "least": ("min", "v"), "most": ("max", "v"), "latest": ("last", "v"), "before": ("previous", "v"), "number": ("number", "")}


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_scan_equals_one_pass(spark, ranges):
    rng = random.Random(ranges)
    data = [(i, rng.choice([None, "hot", "hot", "hot", "b", "c"]), rng.choice([None, rng.randrange(-50, 50)])) for i in range(900)] + [(2000 + i, f"k{i}", i) for i in range(60)]
    df = spark.createDataFrame(data, "id int, k string, v int").repartition(5)
    assert rows(scan(df, ["id"], ranges=ranges, **PORTS)) == folded(data, lambda r: 0, lambda r: r[0])
    assert rows(scan(df, ["id desc"], ["k"], ranges=ranges, **PORTS)) == folded(data, lambda r: r[1], lambda r: -r[0])
    assert rows(R.running(df, ["id"], ["k"], x=("last", "v"))) == rows(R.running(df, ["id"], ["k"], ranges=ranges, x=("last", "v")))


def test_no_range_holds_a_hot_key(spark):
    """One key with all the rows: every window is over a range, and the ranges are even."""
    df = spark.range(20_000).select(F.col("id"), F.lit("hot").alias("k"))
    out = scan(df, ["id"], ["k"], ranges=20, total=("sum", "id"))
    assert out.agg(F.max("total")).first()[0] == 19_999 * 10_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    over = plan.split("windowspecdefinition(")[1:]
    assert [w.startswith("_range") for w in over] == [True, False]  # the rows' window, and that of the carries
    assert "ResolvedHint (strategy=broadcast)" in plan or "rightHint=(strategy=broadcast)" in plan
    sizes = [r["count"] for r in df.repartitionByRange(20, "k", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * 1000


def test_scan_of_texts_decimals_and_no_rows(spark):
    df = spark.createDataFrame([(1, "b", Decimal("1.50")), (2, "a", Decimal("2.25")), (3, None, None)], "id int, s string, d decimal(10,2)")
    got = scan(df, ["id"], least=("min", "s"), latest=("last", "s"), total=("sum", "d"), ranges=3)
    assert rows(got.select("id", "least", "latest", "total")) == [(1, "b", "b", Decimal("1.50")), (2, "a", "a", Decimal("3.75")), (3, "a", "a", Decimal("3.75"))]
    assert got.schema["total"].dataType == df.agg(F.sum("d").alias("t")).schema["t"].dataType
    assert scan(df.limit(0), ["id"], ["s"], x=("sum", "d")).count() == 0
    for bad in (lambda: scan(df, [], x=("sum", "d")), lambda: scan(df, ["id"], x=("median", "d"))):
        with pytest.raises(ValueError):
            bad()


def test_as_of_by_ranges(spark):
    rng = random.Random(8)
    l = spark.createDataFrame([(i, rng.choice(["x", "y"]), rng.randrange(100)) for i in range(300)], "id int, k string, t int")  # noqa: E741
    r = spark.createDataFrame([(rng.choice(["x", "x", "x", "z"]), rng.randrange(100), i) for i in range(200)], "k string, u int, v int")
    want = sorted((a["id"], max(((b["u"], b["v"]) for b in r.collect() if b["k"] == a["k"] and b["u"] <= a["t"]), default=(None, None))[1]) for a in l.collect())
    for ranges in (None, 6):
        got = J.as_of(l, r, ["k"], "t", "u", ["v"], ["v"], ranges)
        assert [(i, v) for i, v in sorted((x["id"], x["v"]) for x in got.collect())] == want


# Joins by nearness


@pytest.mark.parametrize("part", [100_000, 15])
def test_band_join_equals_all_pairs(spark, part):
    rng = random.Random(part)
    a = [(i, rng.choice([None, float("nan"), 5.0, 5.0, 5.0, rng.uniform(-20, 20)])) for i in range(160)]
    b = [(i, rng.choice([None, 5.0, 5.0, 7.5, rng.uniform(-20, 20)])) for i in range(140)]
    l, r = spark.createDataFrame(a, "a int, x double"), spark.createDataFrame(b, "b int, y double").repartition(3)  # noqa: E741
    for low, high in ((-1.5, 2.5), (0, 0), (3, 4)):
        want = sorted((i, j) for i, x in a for j, y in b if x is not None and y is not None and x + low <= y <= x + high)
        got = B.band_join(l, r, "x", "y", low, high, part)
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((q["a"], q["b"]) for q in got.collect()) == want
    with pytest.raises(ValueError):
        B.band_join(l, r, "x", "y", 2, 1)
    with pytest.raises(ValueError):
        B.band_join(l, l, "x", "x", 0, 1)


@pytest.mark.parametrize("part", [100_000, 20])
def test_within_equals_all_pairs(spark, part):
    rng = random.Random(part)
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    spans = [(i, day(s), day(s + rng.choice([0, 0, 1, 3, 8, 200, 3000]))) for i, s in enumerate(rng.choice([50, rng.randrange(400)]) for _ in range(120))] + [(900, day(9), day(3)), (901, None, day(3)), (902, day(3), None)]
    points = [(i, rng.choice([None, day(50), day(rng.randrange(500))])) for i in range(150)]
    p, s = spark.createDataFrame(points, "p int, d date"), spark.createDataFrame(spans, "s int, f date, t date").repartition(3)
    for closed in ("both", "left"):
        want = sorted((i, j) for i, d in points for j, f, t in spans if d and f and t and f <= d and (d <= t if closed == "both" else d < t))
        got = B.within(p, s, "d", "f", "t", closed, part)
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((q["p"], q["s"]) for q in got.collect()) == want
    other = s.selectExpr("s as r", "f as g", "t as u")
    want = sorted((i, j) for i, f, t in spans for j, g, u in spans if f and t and g and u and f <= t and g <= u and f <= u and g <= t)
    assert sorted((q["s"], q["r"]) for q in B.overlapping(s, other, ("f", "t"), ("g", "u"), part).select("s", "r").collect()) == want
    assert B.within(p, s.limit(0), "d", "f", "t").count() == 0
    with pytest.raises(ValueError):
        B.within(p, s, "d", "f", "t", "right")


def test_counts_of_overlaps_shuffle_no_pairs(spark):
    rng = random.Random(3)
    made = lambda n, keys: [(rng.choice(keys), a, a + rng.choice([0, 0, 3, 40])) for a in (rng.randrange(100) for _ in range(n))] + [(keys[0], 5, 4), (keys[1], None, 9)]
    a, b = made(60, [None, "x", "y", "z"]), made(50, [1, 2, 3, None])
    want = {}
    for k, s, e in a:
        for m, t, u in b:
            if None not in (s, t) and s <= e and t <= u and s <= u and t <= e:
                want[k, m] = want.get((k, m), 0) + 1
    l, r = spark.createDataFrame(a, "k string, s int, e int"), spark.createDataFrame(b, "m long, t int, u int")
    for part in (7, 100):
        out = B.overlap_counts(l, r, "k", "m", ("s", "e"), ("t", "u"), "n", part)
        assert sorted(map(str, (tuple(q) for q in out.collect()))) == sorted(str((*k, n)) for k, n in want.items())
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert B.overlap_counts(l.limit(0), r, "k", "m", ("s", "e"), ("t", "u"), "n").count() == 0


def test_spans_of_many_blocks_are_kept_once(spark, monkeypatch):
    """Blocks meet where they lie: no copy of a span is shuffled for each block of the other side."""
    l, r = spark.range(300).selectExpr("id % 90 as k", "id % 50 as s", "id % 50 + id % 7 as e"), spark.range(200).selectExpr("id % 80 as m", "id % 60 as t", "id % 60 + id % 3 as u")  # noqa: E741
    kept, plain = [], B.materialised
    monkeypatch.setattr(B, "materialised", lambda d: kept.append(plain(d)) or kept[-1])
    out = B.overlap_counts(l, r, "k", "m", ("s", "e"), ("t", "u"), "n", 20)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    blocks = [d for d in kept if d.columns[0] in ("l_k", "r_k")]
    assert [d.selectExpr(f"sum(size({d.columns[1]}))").first()[0] for d in blocks] == [300, 200]
    assert all(d.count() > 5 for d in blocks)
    want = l.join(r, (F.col("s") <= F.col("u")) & (F.col("t") <= F.col("e"))).groupBy("k", "m").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("tile, at_once", [(3, 15), (2, 10**6), (512, 40)])
def test_counts_of_two_blocks_by_tiles_and_slices(monkeypatch, tile, at_once):
    rng = random.Random(tile)
    monkeypatch.setattr(B, "TILE", tile)
    monkeypatch.setattr(B, "AT_ONCE", at_once)
    made = lambda n, keys, times: [(rng.choice(keys), a, a + rng.choice(times)) for a in (rng.choice(times) * 3 for _ in range(n))]
    sides = made(70, [None, *"abcdefgh"], [0, 1, 5, 30]), made(60, [1, 2, 3, None, 9, 10, 11], [0.0, 0.5, 5.0, 29.5])
    blocks = [list(B._packed(iter([pa.record_batch(list(map(pa.array, zip(*x, strict=True))), names=["k", "a", "b"]) for x in (rows[:40], [], rows[40:]) if x]))) for rows in sides]
    assert [len(b) for b in blocks] == [1, 1]
    pair = pa.record_batch([c for (b,) in blocks for c in b.columns], names=list("abcdefgh"))
    got = [(k, m, n) for batch in B._counted(iter([pair])) for k, ms, ns in zip(*(c.to_pylist() for c in batch.columns), strict=True) for m, n in zip(ms, ns, strict=True)]
    want = collections.Counter((k, m) for k, a, b in sides[0] for m, c, d in sides[1] if a <= d and c <= b)
    assert len(got) == len(want) and {(k, m): n for k, m, n in got} == want
