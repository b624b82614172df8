"""Strongly connected components against a depth-first search, and the counts of loads and streams with late rows."""

import datetime
import random
import time

import pytest

from weirflow.graph import cycles as C
from weirflow.streaming import counted as K
from weirflow.streaming import windows as W


def tarjan(edges):
    nodes = {n for e in edges for n in e}
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for m in out[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        reach[n] = seen
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


def depths(edges, parts):
    e = {(parts[a], parts[b]) for a, b in edges if parts[a] != parts[b]}
    deep = dict.fromkeys(parts.values(), 0)
    for _ in deep:
        for a, b in e:
            deep[b] = max(deep[b], deep[a] + 1)
    return deep


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_layers(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(24), rng.randrange(24)) for _ in range(18 + 10 * seed)] + [(30, 31), (31, 32), (32, 30), (32, 33), (40, 40), (41, 42)]
    df = spark.createDataFrame([*edges, (None, 1), (1, None), edges[0]], "source int, target int")
    want = tarjan(edges)
    assert {r["node"]: r["component"] for r in C.components(df).collect()} == want
    deep = depths(edges, want)
    assert {r["node"]: r["layer"] for r in C.layers(df).collect()} == {n: deep[c] for n, c in want.items()}
    inside = [(a, b) for a, b in set(edges) if want[a] == want[b]]
    assert {r["component"]: (r["n_nodes"], r["n_edges"]) for r in C.cycles(df).collect()} == {c: (sum(x == c for x in want.values()), sum(want[a] == c for a, _ in inside)) for c in {want[a] for a, _ in inside}}


def test_no_edges(spark):
    df = spark.createDataFrame([], "source string, target string")
    assert C.components(df).count() == C.layers(df).count() == C.cycles(df).count() == 0


def test_a_load_is_counted_as_it_passes(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i) for i in range(100)], "id int, v int")
    got = K.counted_load(df, str(tmp_path / "out"), {"has a value": "v is not null", "is small": "v < 50"})
    assert got == {"read": 100, "has a value": 15, "is small": 43, "written": 42}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 42


def test_late_rows_go_to_the_side(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    parts = [[(1, at(0)), (2, at(30)), (3, at(1))], [(4, at(5)), (5, at(26)), (6, None)], [(7, at(60))], [(8, at(31)), (9, at(61))]]
    schema = "id int, ts timestamp"
    listener = K.Progress()
    spark.streams.addListener(listener)
    try:
        for n, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            assert K.keep_with_late(stream, "ts", "5 minutes", str(tmp_path / "kept"), str(tmp_path / "cp")).awaitTermination(60)
            w = W.windowed(stream, "tumbling", "ts", [], {"n": "count(*)"}, size="10 minutes", delay="5 minutes")
            q = w.writeStream.format("parquet").option("path", str(tmp_path / "w")).option("checkpointLocation", str(tmp_path / "wcp")).outputMode("append").queryName("windows").trigger(availableNow=True).start()
            assert q.awaitTermination(60)
        for _ in range(50):  # reports come a little later
            seen = listener.table(spark).where("name = 'windows'").agg({"rows_in": "sum", "dropped_late": "sum"}).first()
            if seen["sum(rows_in)"] == 9:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert {r["id"] for r in K.on_time(spark, str(tmp_path / "kept")).collect()} == {1, 2, 3, 5, 7, 9}
    assert {(r["id"], r["side"]) for r in K.late(spark, str(tmp_path / "kept")).collect()} == {(4, "late"), (6, "untimed"), (8, "late")}
    total = K.counts(spark, str(tmp_path / "kept")).agg({"read": "sum", "late": "sum", "on_time": "sum", "untimed": "sum"}).first()
    assert (total["sum(read)"], total["sum(late)"], total["sum(on_time)"], total["sum(untimed)"]) == (9, 2, 6, 1)
    assert seen["sum(rows_in)"] == 9 and seen["sum(dropped_late)"] >= 1


@pytest.mark.parametrize("turned", [False, True])
def test_long_chains_take_few_rounds(spark, turned, monkeypatch):
    """A ring of 200 nodes, a tail into it, and a knot that chains lead out of and back into."""
    edges = [(i, (i + 1) % 200) for i in range(200)] + [(300 + i, 301 + i) for i in range(40)] + [(340, 7)]
    edges += [(500, 501), (500, 510), (501, 502), (501, 520), (502, 500), (502, 530)] + [(510 + i, 511 + i) for i in range(4)] + [(514, 501), (520, 521), (521, 600), (530, 531), (531, 500), (540, 531), (541, 540), (600, 601)]
    edges = [(b, a) if turned else (a, b) for a, b in edges]
    cuts, plain = [], C._cut
    monkeypatch.setattr(C, "_cut", lambda d: cuts.append(1) or plain(d))
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "source int, target int")).collect()}
    assert got == tarjan(edges)
    assert len(cuts) < 80
