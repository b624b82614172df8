"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.arrow import shared_dir


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of every node that ``edges`` (a, b) names.

    Alternating star steps: every node's larger neighbours, then its smaller ones and itself, are hung on the
    least node around it, until nothing changes, which takes a number of rounds in the order of the square of the size's logarithm. A round is two
    aggregations with map-side minima and two joins that Spark can split, so no neighbourhood is ever gathered
    in one place: minima are checkpointed, as Spark splits the rows of a hub only between two plain shuffles. Null nodes and loops are left out; with no edges the result is empty.
    """
    shared_dir(edges.sparkSession)
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).checkpoint()
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = large.checkpoint()
        least = large.groupBy("a").agg(F.min("b").alias("m")).checkpoint()
        hung = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
