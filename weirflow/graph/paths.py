"""Ways through a graph with what becomes of a value on them: column lineage on edge tables (source, target, kind).

A way is as derived as its most derived step (passthrough, expression, coarse) and as sure as the product of its steps' confidence. Ways grow by a join a step; of the ways from one origin to one node the
first ``k`` stay, shorter ones first and equal ones by their nodes' names, and only these go on. Without cycles these are the first k of all ways; with cycles a way that a node is on already is not
entered again, so every way ends, and those that begin with a way that did not stay are left out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.shared import materialised

#: From the least to the most derived, with the confidence of a step.
KINDS = {"passthrough": 1.0, "expression": 0.9, "coarse": 0.5}
WAYS = 8
DEEPEST = 40


def ways(edges: DataFrame, start: DataFrame, k: int = WAYS, deepest: int = DEEPEST, kinds: Mapping[str, float] = KINDS) -> DataFrame:
    """``origin``, ``node``, ``steps``, ``path`` (nodes joined by >), ``kind`` and ``confidence`` of the ways from each start node (column ``node``). Steps of an unknown or null kind are as the last one of ``kinds``; of several edges between two nodes the least derived counts."""
    names, worst = list(kinds), len(kinds) - 1
    rank = F.lit(worst)
    sure = F.lit(float(kinds[names[-1]]))
    for i, name in enumerate(names):
        rank = F.when(F.col("kind") == name, i).otherwise(rank)
    e = edges.where("source is not null and target is not null").select(F.col("source").cast("string").alias("_s"), F.col("target").cast("string").alias("_t"), rank.alias("_k")).groupBy("_s", "_t").agg(F.min("_k").alias("_k"))
    for i, name in enumerate(names):
        sure = F.when(F.col("_k") == i, float(kinds[name])).otherwise(sure)
    e = materialised(e.withColumn("_c", sure))
    node = F.col("node").cast("string")
    front = start.select(node.alias("origin"), node.alias("node")).where("node is not null").distinct().select("origin", "node", F.array("node").alias("_p"), F.lit(0).alias("_k"), F.lit(1.0).alias("confidence"))
    kept = None
    first = Window.partitionBy("origin", "node").orderBy("_p")
    for _ in range(deepest):
        grown = front.withColumnsRenamed({"_k": "_k0", "confidence": "_c0"}).join(e, F.col("node") == F.col("_s")).where(~F.array_contains("_p", F.col("_t")))
        grown = grown.select("origin", F.col("_t").alias("node"), F.concat("_p", F.array("_t")).alias("_p"), F.greatest("_k0", "_k").alias("_k"), (F.col("_c0") * F.col("_c")).alias("confidence"))
        if kept is not None:
            held = kept.groupBy("origin", "node").agg(F.count("*").alias("_held"))
            grown = grown.join(held, ["origin", "node"], "left").withColumn("_held", F.coalesce("_held", F.lit(0)))
        else:
            grown = grown.withColumn("_held", F.lit(0))
        front = grown.withColumn("_n", F.row_number().over(first)).where(f"_n <= {int(k)}").where(F.col("_n") + F.col("_held") <= k).drop("_n", "_held")
        front = materialised(front)
        if front.isEmpty():
            break
        kept = front if kept is None else materialised(kept.unionByName(front))
    out = front if kept is None else kept
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_k") + 1)
    return out.select("origin", "node", (F.size("_p") - 1).alias("steps"), F.array_join("_p", ">").alias("path"), label.alias("kind"), F.round("confidence", 6).alias("confidence"))
