"""Hard negatives against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, slot string"


def brute(rows, every=100, positives=5, negatives=10, least=30, most=90):
    base = set()
    for i, v, l in rows:  # noqa: E741
        if i is None or v is None or l is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        base.add((i, int(math.fmod(l + 1, 10)) if i % 7 == 0 else l, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in base:
        if a[0] % every:
            continue
        first = lambda rows, k: sorted(((-dot(a[2], b[2]), b[0]) for b in rows))[:k]  # noqa: B023, E731
        for s, p in first((b for b in base if b[1] == a[1] and b != a), positives):
            hard = [b for b in base if b[1] != a[1] and least * -s <= 100 * dot(a[2], b[2]) <= most * -s]
            out += [(a[0], p, k, n, -s, -t) for k, (t, n) in enumerate(first(hard, negatives), 1)]
    return sorted(out)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 0.5, "s") for r in rows], SCHEMA).repartition(parts)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    out = []
    for i in range(900):
        v = centres[rng.integers(12)] * rng.uniform(0.2, 2) + rng.normal(size=8) * 0.3
        out.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(10))))
    out[5:9] = [(5, None, 1), (6, [1.0], None), (8, [float("nan")] * 8, 2), (9, [float("inf"), 1.0], 2)]
    out += [(None, [1.0] * 8, 3), (100, [1.0, 2.0], 3), (100, [1.0, 2.0], 3), (100, [2.0, 1.0], 4), (900, [], 3), (1000, [None, 1.0], 3), (1100, [0.0] * 8, 5), (300, out[300][1], (out[300][2] + 1) % 10), (777, [-1.0] * 8, -3)]
    out += [(2000 + i, [0.5, 0.25, 1.0, 0.0, 0.0, 0.0, 0.0, 2.0], 3) for i in range(150)]  # one vector that many rows share, of one label
    return out


def test_same_as_all_products(spark, rows):
    want = brute(rows)
    assert len(want) > 400
    assert got(hn.digest(frame(spark, rows))) == want


def test_blocks_and_other_numbers(spark, rows):
    made = hn.mine(frame(spark, rows), F.col("vec_id") % 20 == 0, label=F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")), positives=3, negatives=4, least=-20, most=100, block=10, pivots=3)
    assert got(made) == brute(rows, 20, 3, 4, -20, 100)


def test_pivots_spare_products(monkeypatch):
    """Clusters that lie far apart are skipped by their brackets; the first rows stay the same with any pivots."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 40
    vec = np.floor(np.concatenate([c + rng.normal(size=(200, 16)) for c in centres]))
    square = float((vec * vec).sum(axis=1).max())
    label = rng.integers(0, 3, len(vec))
    found = {}
    for n, run in ((1, 512), (24, 100)):
        monkeypatch.setattr(hn, "RUN", run)
        pivots = hn.far_apart(vec[rng.permutation(len(vec))[:500]], square, n)
        far = hn.distances(hn.augmented(vec, square), pivots)
        lists = lambda x: hn.pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], hn.pa.array(x.ravel()))
        batch = hn.pa.RecordBatch.from_arrays([hn.pa.array(np.arange(len(vec))), hn.pa.array(label), lists(vec), lists(far)], ["id", "label", "vec", "far"])
        a = np.arange(0, len(vec), 97)
        anchors = hn.Anchors(a, label[a], vec[a], (vec[a] ** 2).sum(axis=1), hn.distances(np.c_[vec[a], np.zeros(len(a))], pivots))
        best = hn.Best(len(a), 5)
        checked = hn.scan(batch, anchors, best, hn.Table(None, pivots, 16, square), 0, (30, 90))
        found[n] = checked, sorted(zip(best.slot.tolist(), best.score.tolist(), best.id.tolist(), strict=True))
    assert found[1][1] == found[24][1]
    assert found[24][0] < 0.6 * found[1][0] < 0.6 * len(a) * len(vec)


def test_large_numbers(spark):
    """Beyond doubles that are exact products are taken in longs; beyond longs they are refused."""
    rows = [(100, [500_000.0, 3.0], 1), (1, [499_999.0, 7.0], 1), (2, [300_000.0, 1.0], 2), (3, [300_000.0, 1.00390625], 2)]
    want = brute(rows)
    assert len(want) == 2
    assert got(hn.digest(frame(spark, rows))) == want
    with pytest.raises(ValueError, match="too long"):
        hn.digest(frame(spark, [(100, [1e9], 1)]))


def test_no_rows(spark):
    assert hn.digest(frame(spark, [])).count() == 0
    assert hn.digest(frame(spark, [(100, [1.0], 1)])).count() == 0
    assert hn.digest(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0
