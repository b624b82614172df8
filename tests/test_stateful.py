"""Stateful stream operators against the batch operators, over several runs of one checkpoint."""

import datetime
import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weirflow.operators import joins as J
from weirflow.operators import rows as R
from weirflow.streaming import stateful as S

BASE = datetime.datetime(2024, 1, 1)
SCHEMA = "id int, ts timestamp, k string, v int, d decimal(10,2)"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def feed(spark, folder, data, schema=SCHEMA):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(df, path, until_stopped=0):
    """One run over what is there; a further one with the same path goes on from its checkpoint."""
    w = df.writeStream.format("parquet").option("checkpointLocation", f"{path}-cp").option("path", str(path)).outputMode("append")
    q = (w if until_stopped else w.trigger(availableNow=True)).start()
    if until_stopped:
        for _ in range(150):
            time.sleep(0.2)
            if sum(p["numInputRows"] for p in q.recentProgress) == until_stopped:
                break
        q.stop()
    else:
        assert q.awaitTermination(60)
    assert q.exception() is None


@pytest.fixture
def data():
    rng = random.Random(1)
    return [(i, BASE + datetime.timedelta(seconds=i), rng.choice([None, "a", "b", "c", "hot", "hot", "hot"]), rng.choice([None, rng.randrange(100)]), rng.choice([None, Decimal("1.25")])) for i in range(300)]


def test_dynamic_lookup_goes_on_after_a_restart(spark, tmp_path, data):
    held = spark.createDataFrame([("b", 7), ("z", 8)], "k string, v int")
    stream = lambda: S.dynamic_lookup(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), held, ["k"], ["ts", "id"], ["v"])
    for part in (data[:100], data[100:180], data[180:]):
        feed(spark, tmp_path / "in", part)
        run(stream(), tmp_path / "out")
    want = J.dynamic_lookup(spark.createDataFrame(data, SCHEMA), held, ["k"], ["ts", "id"], ["v"])[0]
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == want.columns
    assert rows(got) == rows(want)
    assert rows(S.dynamic_lookup(spark.createDataFrame(data, SCHEMA), held, ["k"], ["ts", "id"], ["v"])) == rows(want)
    with pytest.raises(ValueError, match="order"):
        S.dynamic_lookup(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), held, ["k"], [], ["v"])


def test_running_values_go_on_after_a_restart(spark, tmp_path, data):
    ports = {"total": ("sum", "d"), "n": ("count", "v"), "least": ("min", "v"), "most": ("max", "v"), "latest": ("last", "v"), "before": ("previous", "v + 1"), "number": ("number", "")}
    stream = lambda: S.running(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ["ts", "id"], ["k"], **ports)
    for part in (data[:140], data[140:150], data[150:]):
        feed(spark, tmp_path / "in", part)
        run(stream(), tmp_path / "out")
    want = R.running(spark.createDataFrame(data, SCHEMA), ["ts", "id"], ["k"], ranges=2, **ports)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == want.columns and got.schema["total"].dataType == want.schema["total"].dataType
    assert rows(got) == rows(want)
    with pytest.raises(ValueError):
        S.running(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ["ts"], [], n=("count", "v"))


def test_state_goes_after_its_time(spark, tmp_path):
    """With a TTL of a millisecond nothing is held from one run to the next."""
    stream = lambda: S.running(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ["id"], ["k"], ttl_ms=1, n=("number", ""))
    for i in (1, 2):
        feed(spark, tmp_path / "in", [(i, BASE, "a", 1, None), (i + 10, BASE, "a", 1, None)])
        run(stream(), tmp_path / "out", until_stopped=2)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("id", "n")) == [(1, 1), (11, 2), (12, 2), (2, 1)]


def test_twin_holds_the_latest_of_each_attribute(spark, tmp_path):
    data = [(1, BASE, "a", 5, None), (2, BASE, "b", 6, None), (3, BASE + datetime.timedelta(1), "a", 7, None), (4, BASE - datetime.timedelta(1), "b", 1, None), (5, BASE, None, 1, None)]
    stream = lambda: S.twin(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).withColumn("dev", F.lit("x")), ["dev"], "k", "v", ["ts"])
    for part in (data[:2], data[2:]):
        feed(spark, tmp_path / "in", part)
        run(stream(), tmp_path / "out")
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("x", "a", 5), ("x", "a", 7), ("x", "b", 6)]
    batch = S.twin(spark.createDataFrame(data, SCHEMA).withColumn("dev", F.lit("x")), ["dev"], "k", "v", ["ts"])
    assert rows(batch) == [("x", "a", 7), ("x", "b", 6)]


def test_silent_keys_are_told_once_the_watermark_is_past(spark, tmp_path):
    at = lambda m: BASE + datetime.timedelta(minutes=m)
    first = [(1, at(0), "a", 1, None), (2, at(1), "b", 1, None), (3, at(4), "a", 1, None)]
    then = [(4, at(30), "b", 1, None)]
    last = [(5, at(90), "c", 1, None)]
    stream = lambda: S.silent(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ["k"], "ts", "10 minutes", "1 minute")
    for part in (first, then, last):
        feed(spark, tmp_path / "in", part)
        run(stream(), tmp_path / "out")
    run(stream(), tmp_path / "out")
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("a", at(4)), ("b", at(1)), ("b", at(30))]
    assert rows(S.silent(spark.createDataFrame([*first, *then, *last], SCHEMA), ["k"], "ts", "10 minutes")) == [("a", at(4)), ("b", at(1)), ("b", at(30))]
