"""Joins and deduplication of streams against the same on tables, over two runs of one checkpoint."""

import datetime
import random

from pyspark.sql import functions as F

from weirflow.streaming import windows as W

BASE = datetime.datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def run(df, path):
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-cp").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90) and q.exception() is None


def test_two_streams_within_an_interval(spark, tmp_path):
    rng = random.Random(4)
    at = lambda n: BASE + datetime.timedelta(minutes=n)
    left = [(i, rng.choice(["a", "b", None]), at(3 * i)) for i in range(60)]
    right = [(100 + i, rng.choice(["a", "b", None]), at(2 * i)) for i in range(90)]
    names = ("l int, k string, lt timestamp", "r int, k string, rt timestamp")
    frames = [spark.createDataFrame(d, n) for d, n in zip((left, right), names, strict=True)]
    want = rows(W.interval_join(*frames, ["k"], "lt", "rt", "10 minutes"))
    for half in (0, 1):
        for side, data, n in (("l", left, names[0]), ("r", right, names[1])):
            cut = len(data) // 2
            spark.createDataFrame(data[cut:] if half else data[:cut], n).coalesce(1).write.mode("append").parquet(str(tmp_path / side))
        streams = [spark.readStream.schema(n).parquet(str(tmp_path / s)) for s, n in zip("lr", names, strict=True)]
        run(W.interval_join(*streams, ["k"], "lt", "rt", "10 minutes", delay="3 hours"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert len(want) > 50 and rows(got) == want


def test_a_stream_without_repeats(spark, tmp_path):
    data = [(i % 7, BASE + datetime.timedelta(seconds=i)) for i in range(40)]
    for part in (data[:20], data[20:]):
        spark.createDataFrame(part, "k int, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "in"))
        run(W.deduplicated(stream, ["k"], "ts", "1 hour").select("k"), str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(k,) for k in range(7)]
    assert W.deduplicated(spark.createDataFrame(data, "k int, ts timestamp"), ["k"], "ts").select(F.col("k")).count() == 7
