"""Questions about graphs of tables and columns, as joins of an edge list (source, target)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.shared import materialised as _cut


def reach(edges: DataFrame, start: DataFrame, deepest: int | None = None) -> DataFrame:
    """origin, node and depth: whatever each start node (column node) reaches, at the least number of steps (``deepest`` at most, if given); itself at 0.

    A join a step with the nodes reached last only; cycles end, as no node is entered twice.
    """
    front = start.select(F.col("node").alias("origin"), "node").distinct().withColumn("depth", F.lit(0))
    seen = front
    e = edges.select(F.col("source").alias("_s"), F.col("target").alias("_t")).distinct()
    for depth in count(1) if deepest is None else range(1, deepest + 1):
        nxt = front.join(e, F.col("node") == F.col("_s")).select("origin", F.col("_t").alias("node")).distinct()
        front = _cut(nxt.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = _cut(seen.unionByName(front))
    return seen


def impact(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Of each start node: how many nodes it reaches, how far, and a band of risk."""
    r = reach(edges, start).groupBy("origin").agg((F.count("*") - 1).alias("affected"), F.max("depth").alias("deepest"))
    risk = F.when(F.col("affected") >= 10, "CRITICAL").when(F.col("affected") >= 6, "HIGH").when(F.col("affected") >= 3, "MEDIUM").otherwise("LOW")
    return r.withColumn("risk", risk)


def root_causes(edges: DataFrame, failing: DataFrame, n: int = 15) -> DataFrame:
    """For each failing node its ancestors by fan-out over distance, the first n by score, distance and name."""
    from weirflow.operators.aggregates import top

    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    fan = edges.groupBy(F.col("source").alias("_f")).agg(F.count_distinct("target").alias("fan_out"))
    up = reach(back, failing).filter("depth > 0").join(fan, F.col("node") == F.col("_f"))
    return top(up.select("origin", "node", "depth", "fan_out", (F.col("fan_out") / F.col("depth")).alias("score")), n, ["-score", "depth", "node"], ["origin"], "row_number")


def dead_ends(nodes: DataFrame, edges: DataFrame, consumers: tuple[str, ...]) -> DataFrame:
    """Nodes (node, kind) from which no consumer can be reached."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    used = reach(back, nodes.filter(F.col("kind").isin(*consumers))).select("node").distinct()
    return nodes.join(used, "node", "left_anti")


def collapsed(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Edges between owners (node, owner) of different nodes."""
    a = owner.select(F.col("node").alias("source"), F.col("owner").alias("source_owner"))
    b = owner.select(F.col("node").alias("target"), F.col("owner").alias("target_owner"))
    return edges.join(a, "source").join(b, "target").filter("source_owner <> target_owner").groupBy("source_owner", "target_owner").agg(F.count("*").alias("n_edges"))


def repeated(items: DataFrame, name: str, text: str) -> DataFrame:
    """Groups of items whose text is the same but for case and white space: fingerprint, n_items and their names, which the result holds in one row."""
    norm = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return items.groupBy(F.md5(norm).alias("fingerprint")).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_set(name)), ",").alias("names")).filter("n_items > 1")


def connected(edges: DataFrame) -> DataFrame:
    """node and group (its least node): ASSOCIATION. Least names spread along edges, and along what nodes point to, until none changes."""
    both = edges.select("source", "target").union(edges.select("target", "source")).filter("source is not null and target is not null").distinct()
    labels = _cut(both.groupBy(F.col("source").alias("node")).agg(F.least(F.min("target"), F.col("source")).alias("group")))
    while True:
        near = both.join(labels.select(F.col("node").alias("target"), "group"), "target").groupBy(F.col("source").alias("node")).agg(F.min("group").alias("g"))
        step = labels.join(near, "node").select("node", F.least("group", "g").alias("group"))
        jump = step.join(step.select(F.col("node").alias("_n"), F.col("group").alias("_g")), F.col("group") == F.col("_n"), "left")
        new = _cut(jump.select("node", F.coalesce("_g", "group").alias("group")))
        if new.join(labels.withColumnRenamed("group", "old"), "node").filter("group <> old").isEmpty():
            return new
        labels = new
