"""Versioned tables: what a change rewrites, what a writer that dies leaves, what a replay does."""

import pytest
from pyspark.sql import functions as F

from weirflow.operators import loads as L
from weirflow.operators import versions as V
from weirflow.streaming import changes as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    V.create(spark.range(2000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v")), path, ["k"], 32)
    return path


def test_a_small_change_rewrites_its_buckets(spark, table):
    first = V.describe(spark, table)
    source = spark.createDataFrame([(5, "five"), (9000, "new"), (7, None)], "k int, v string")
    want = rows(L.merge(V.read(spark, table), source, ["k"]))
    second = V.merge_into(table, source)
    assert second.number == 2 and rows(V.read(spark, table)) == want
    changed = [b for b in second.folders if second.folders[b] != first.folders.get(b)]
    assert 1 <= len(changed) <= 3 and len(second.folders) == 32
    assert len(rows(V.read(spark, table, 1))) == 2000  # the first version is still there
    assert V.read(spark, table, 1).where("k = 5").first()["v"] == "v5"
    assert V.merge_into(table, source.limit(0)).number == 2
    with pytest.raises(ValueError):
        V.read(spark, table, 9)


def test_buckets_can_empty_and_fill(spark, table):
    gone = spark.range(2000).selectExpr("id as k", "'x' as v", "'DELETE' as row_action")
    v = V.merge_into(table, gone, action="row_action")
    assert v.folders == {} and V.read(spark, table).count() == 0 and V.read(spark, table).columns == ["k", "v"]
    V.merge_into(table, spark.createDataFrame([(1, "a"), (None, "n"), (None, "m")], "k bigint, v string"))
    assert rows(V.read(spark, table)) == [(1, "a"), (None, "m"), (None, "n")]


def test_a_writer_that_dies_leaves_the_last_version(spark, table, monkeypatch):
    before = rows(V.read(spark, table))
    source = spark.createDataFrame([(5, "five")], "k int, v string")
    for step in ("_write", "_commit"):  # before and after the data are written
        with monkeypatch.context() as m:

            def dies(*a, **b):
                raise OSError("lost")

            m.setattr(V, step, dies)
            with pytest.raises(OSError):
                V.merge_into(table, source)
        assert V.versions(spark, table) == [1] and rows(V.read(spark, table)) == before
    V.merge_into(table, source)
    assert V.vacuum(spark, table, keep=1) == 1  # what the second left; the first version's folder serves the others' buckets
    assert V.read(spark, table).where("k = 5").first()["v"] == "five" and V.read(spark, table).count() == 2000


def test_the_second_of_two_writers_is_refused(spark, table):
    now = V.describe(spark, table)
    V.merge_into(table, spark.createDataFrame([(5, "five")], "k int, v string"))
    with pytest.raises(V.Conflict):
        V._commit(spark, table, V.replace(now, number=2))
    assert V.read(spark, table).where("k = 5").first()["v"] == "five"


def test_a_replay_changes_nothing(spark, table):
    source = spark.createDataFrame([(5, "five")], "k int, v string")
    assert V.merge_into(table, source, "s", 0).number == 2
    assert V.merge_into(table, source, "s", 0).number == 2
    assert V.merge_into(table, source, "other", 0).number == 3
    assert V.merge_into(table, source.limit(0), "s", 1).tokens == {"s": 1, "other": 0}


def test_a_stream_keeps_a_versioned_table(spark, tmp_path):
    schema = "k int, seq int, op string, v string"
    parts = [[(1, 1, "c", "a"), (2, 1, "c", "q"), (3, 1, "c", "z")], [(1, 3, "u", "b"), (2, 2, "d", None)], [(1, 2, "u", "old"), (2, 1, "u", "again"), (4, 1, "c", "w")]]
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = V.keep_versioned(spark.readStream.schema(schema).parquet(src), out, cp, ["k"], ["seq"], "op", buckets=8)
        assert q.awaitTermination(60) and q.exception() is None
    assert rows(S.current(V.read(spark, out)).select("k", "seq", "v")) == [(1, 3, "b"), (3, 1, "z"), (4, 1, "w")]
    assert V.describe(spark, out).number == 4
