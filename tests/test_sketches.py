"""Sketches merged over loads, and exact percentiles by refinement, against exact figures."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weirflow.operators import quantiles as Q
from weirflow.operators import sketches as K

MEASURES = {"users": ("distinct", "u"), "times": ("quantiles", "v")}


def test_many_loads_stay_within_the_error(spark):
    df = spark.range(60_000).selectExpr("case when id % 3 = 0 then null else id % 2 end as k", "xxhash64(id) % 9000 as u", "pow(xxhash64(id, 7) % 1000, 2) as v", "id % 12 as load")
    state = None
    for n in range(12):
        fresh = K.sketched(df.where(F.col("load") == n), ["k"], MEASURES)
        state = fresh if state is None else K.merged([state, fresh], ["k"], MEASURES)
    got = {r["k"]: r for r in K.estimates(state, ["k"], MEASURES, [0.05, 0.5, 0.95]).collect()}
    assert set(got) == {None, 0, 1}
    for k, r in got.items():
        own = df.where(F.col("k").eqNullSafe(F.lit(k).cast("long")))
        exact, n = own.agg(F.count_distinct("u"), F.count("*")).first()
        assert abs(r["users"] - exact) <= 0.03 * exact
        for p, x in zip((0.05, 0.5, 0.95), r["times"], strict=True):
            below, upto = own.agg(F.count_if(F.col("v") < x), F.count_if(F.col("v") <= x)).first()
            assert below / n - 0.01 <= p <= upto / n + 0.01
    again = K.estimates(K.merged([state, K.sketched(df, ["k"], MEASURES)], ["k"], MEASURES), ["k"], MEASURES).collect()
    assert {r["k"]: r["users"] for r in again} == {k: r["users"] for k, r in got.items()}


def test_empty_sketches(spark):
    df = spark.createDataFrame([("a", None, None)], "k string, u string, v double")
    r = K.estimates(K.sketched(df, ["k"], MEASURES), ["k"], MEASURES).first()
    assert r["users"] == 0 and r["times"] is None
    assert K.estimates(K.sketched(df.limit(0), ["k"], MEASURES), ["k"], MEASURES).count() == 0
    with pytest.raises(ValueError, match="no such sketch"):
        K.sketched(df, ["k"], {"x": ("mode", "u")})


KINDS = {"double": lambda rng: rng.choice([rng.uniform(-1e6, 1e6), 2.0 ** rng.randrange(-300, 300), 5.0]), "bigint": lambda rng: rng.choice([rng.randrange(-(2**62), 2**62), 7, 2**62 + rng.randrange(3)]), "decimal(12,3)": lambda rng: Decimal(rng.randrange(10**6)) / 1000}


@pytest.mark.parametrize("kind", KINDS)
def test_percentiles_of_large_groups(spark, kind):
    rng = random.Random(kind)
    data = [(rng.choice([None, "hot", "hot", "hot", "b"]), KINDS[kind](rng)) for _ in range(700)] + [("one", KINDS[kind](rng)), ("none", None)]
    df = spark.createDataFrame(data, f"k string, v {kind}").repartition(4)
    shares = {"least": 0.0, "p25": 0.25, "mid": 0.5, "p95": 0.95, "most": 1.0}
    want = {r["k"]: r for r in df.where("v is not null").groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in shares.items()]).collect()}
    ranked = {r["k"]: r for r in df.where("v is not null").groupBy("k").agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY v)").alias(n) for n, p in shares.items()]).collect()}
    for large in (50, 10_000):
        got = {r["k"]: r for r in Q.exact_percentiles(df, ["k"], "v", shares, large=large).collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert [r[n] for n in shares] == pytest.approx([want[k][n] for n in shares], rel=1e-12)
        got = {r["k"]: r for r in Q.exact_percentiles(df, ["k"], "v", shares, nearest=True, large=large).collect()}
        assert {k: [float(r[n]) for n in shares] for k, r in got.items()} == {k: [float(r[n]) for n in shares] for k, r in ranked.items()}
    whole = Q.exact_percentiles(df, [], "v", shares, large=50).first()
    assert [whole[n] for n in shares] == pytest.approx(list(df.agg(*[F.percentile("v", p) for p in shares.values()]).first()), rel=1e-12)


def test_percentiles_of_odd_values(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", float("inf")), ("a", 1.0), ("a", 1.0), ("b", None)], "k string, v double")
    assert [tuple(r) for r in Q.exact_percentiles(df, ["k"], "v", {"m": 0.5}, large=1).collect()] == [("a", 1.0)]
    assert Q.exact_percentiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0
    assert Q.exact_percentiles(df.limit(0), [], "v", {"m": 0.5}).count() == 0
    with pytest.raises(ValueError):
        Q.exact_percentiles(df, ["k"], "v", {"m": 50})


def test_rows_of_large_groups_stay_in_their_tasks(spark):
    """No shuffle brings the rows of a group together: of 20,000 rows in three groups only counts are shuffled."""
    df = spark.range(20_000).selectExpr("id % 3 as k", "cast(id as double) as v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    seen, plain = [], Q.materialised
    try:
        Q.materialised = lambda d: seen.append(d._jdf.queryExecution().executedPlan().toString()) or plain(d)
        got = {r["k"]: r["m"] for r in Q.exact_percentiles(df, ["k"], "v", {"m": 0.5}, large=100).collect()}
    finally:
        Q.materialised = plain
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {0: 9999.0, 1: 10000.0, 2: 9999.5}
    assert len(seen) > 2 and not any("SortMergeJoin" in p for p in seen)


def test_values_of_all_magnitudes_take_few_passes(spark, monkeypatch):
    values = [s * 2.0**e for s in (-1, 1) for e in range(-1074, 1024, 3)] + [0.0, 1.7e308, -1.7e308, 5.0, 5.0] + [1.0 + i * 2.0**-52 for i in range(300)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double").repartition(4)
    passes, plain = [], Q.materialised

    def counted(d):
        passes.append(1)
        assert len(passes) < 12
        return plain(d)

    monkeypatch.setattr(Q, "materialised", counted)
    shares = {"least": 0.0, "p1": 0.01, "p40": 0.4, "mid": 0.5, "p55": 0.55, "p99": 0.99, "most": 1.0}
    got = Q.exact_percentiles(df, ["k"], "v", shares, nearest=True, large=50).first()
    ranked = sorted(values)
    assert [got[n] for n in shares] == [ranked[max(math.ceil(p * len(values)) - 1, 0)] for p in shares.values()]
