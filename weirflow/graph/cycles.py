"""Cycles of directed graphs on edge tables (source, target): strongly connected components and the layers of what they condense to.

Every step is a join or an aggregation of edges, cut by a checkpoint; no component, neighbourhood or path is gathered. A colouring gives each node the least node that reaches it; what reaches such a least node
backwards within its colour is its component. Nodes without an edge in or out are taken off before. Chains of nodes with one edge out, or one in, are folded before by doubling their steps, in rounds that go with the logarithm
of their length; a cycle of such nodes is found thereby. On what is left the number of rounds goes with the longest way that a colour takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.shared import materialised as _cut

#: Chains are folded where one node in so many at least has one edge out.
FOLDED = 10


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").where("source is not null and target is not null").distinct()


def _trimmed(e: DataFrame) -> DataFrame:
    """Without nodes that nothing leads into or out of, as far as three rounds take it."""
    for _ in range(3):
        n = e.count()
        e = _cut(e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        if e.count() == n:
            break
    return e


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node of those that it reaches and that reach it, for every node of the edges. Null ends are left out."""
    every = _cut(_edges(edges))
    nodes = every.select(F.col("source").alias("node")).union(every.select("target")).distinct()
    done = _solved(_trimmed(_cut(every.where("source <> target"))))
    if done is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(done, "node", "left").select("node", F.coalesce("colour", "node").alias("component"))


def _solved(left: DataFrame) -> DataFrame | None:
    """``node`` and ``colour``, its component, of nodes of edges without loops; nodes that are left out are alone. None if all are."""
    done = None
    while not left.isEmpty():
        for way in (left, left.select(F.col("target").alias("source"), F.col("source").alias("target"))):
            outs = _cut(way.groupBy("source").agg(F.count("*").alias("n"), F.min("target").alias("to")))
            single = _cut(outs.where("n = 1").select(F.col("source").alias("node"), "to"))
            n = single.count()
            if n * FOLDED >= outs.count():
                found = _folded(way, single, n)
                return found if done is None else found if found is None else done.unionByName(found)
        colour = _cut(left.select(F.col("source").alias("node")).union(left.select("target")).distinct().withColumn("colour", F.col("node")))
        while True:
            come = left.join(colour.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("c"))
            new = _cut(colour.join(come, "node", "left").select("node", F.least("colour", "c").alias("colour")))  # least leaves nulls out
            same = new.join(colour.withColumnRenamed("colour", "old"), "node").where("colour <> old").isEmpty()
            colour = new
            if same:
                break
        # back from each colour's own node, along edges of its colour
        a = colour.select(F.col("node").alias("source"), F.col("colour").alias("cs"))
        b = colour.select(F.col("node").alias("target"), F.col("colour").alias("ct"))
        within = _cut(left.join(a, "source").join(b, "target").where("cs = ct").select("source", "target"))
        front = found = _cut(colour.where("node = colour"))
        while True:
            back = within.join(front.select(F.col("node").alias("target"), "colour"), "target").select(F.col("source").alias("node"), "colour").distinct()
            front = _cut(back.join(found.select("node"), "node", "left_anti"))
            if front.isEmpty():
                break
            found = _cut(found.unionByName(front))
        done = found if done is None else done.unionByName(found)
        keep = lambda e, c: e.join(found.select(F.col("node").alias(c)), c, "left_anti")  # noqa: B023, E731
        left = _trimmed(_cut(keep(keep(left, "source"), "target").select("source", "target")))
    return done


def _folded(left: DataFrame, single: DataFrame, n: int) -> DataFrame:
    """As _solved, where each of the ``n`` nodes of ``single`` leads on to one node (``to``) only: the edges between other nodes are solved, ways along single nodes being edges."""
    steps = [_cut(single.withColumn("least", F.col("node")))]
    while True:
        # twice as many steps, as far as the first node that is not single; a cycle of single nodes goes on
        on = steps[-1].select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        more = steps[-1].join(on, "to", "left")
        if 2 ** (len(steps) - 1) >= n or more.where("least2 is not null").isEmpty():
            break
        steps.append(_cut(more.select("node", F.coalesce("to2", "to").alias("to"), F.least("least", "least2").alias("least"))))
    ends = _cut(more.select("node", "to", "least", F.col("least2").isNotNull().alias("goes_on")))
    round_ = ends.where("goes_on").select(F.col("to").alias("node")).distinct()
    circles = ends.join(round_, "node", "left_semi").select("node", F.col("least").alias("colour"))
    # edges from other nodes, to the end of the chain that they enter; a chain into a cycle leads nowhere else
    entering = left.join(single.select(F.col("node").alias("source")), "source", "left_anti").join(ends.select(F.col("node").alias("target"), "to", "goes_on"), "target", "left")
    entering = _cut(entering.where("goes_on is null or not goes_on").select("source", "target", F.coalesce("to", "target").alias("end"), F.col("to").isNotNull().alias("chain")))
    rest = _solved(_trimmed(_cut(entering.select("source", F.col("end").alias("target")).where("source <> target").distinct())))
    if rest is None:
        same = entering.where("chain and source = end").select(F.col("target").alias("node"), F.col("end").alias("colour"))
    else:
        rest = _cut(rest)
        a, b = rest.select(F.col("node").alias("source"), F.col("colour").alias("ca")), rest.select(F.col("node").alias("end"), F.col("colour").alias("cb"))
        both = entering.where("chain").join(a, "source", "left").join(b, "end", "left")
        same = both.where(F.coalesce("ca", "source") == F.coalesce("cb", "end")).select(F.col("target").alias("node"), F.coalesce("cb", "end").alias("colour"))
    marked = _cut(same.distinct())
    if not marked.isEmpty():
        for step in steps:  # where a way of the component enters a chain, the chain from there on is of the component
            along = marked.join(step, "node").select(F.col("to").alias("node"), "colour")
            marked = _cut(marked.unionByName(along).distinct())
    members = marked.join(single.select("node"), "node", "left_semi").unionByName(marked.select(F.col("colour").alias("node"), "colour"))
    members = members if rest is None else members.unionByName(rest)
    members = _cut(members.distinct())
    least = members.groupBy("colour").agg(F.min("node").alias("least"))
    return _cut(circles.unionByName(members.join(least, "colour").select("node", F.col("least").alias("colour"))))


def condensed(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges between components (node, component), which have no cycle."""
    a = parts.select(F.col("node").alias("source"), F.col("component").alias("a"))
    b = parts.select(F.col("node").alias("target"), F.col("component").alias("b"))
    return _edges(edges).join(a, "source").join(b, "target").where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target")).distinct()


def layers(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` and ``layer``: how many components the longest way to its own goes through; a step for each layer."""
    parts = _cut(components(edges))
    left = _cut(condensed(edges, parts))
    todo = _cut(parts.select("component").distinct())
    out, layer = None, 0
    while not todo.isEmpty():
        first = _cut(todo.join(left.select(F.col("target").alias("component")).distinct(), "component", "left_anti").withColumn("layer", F.lit(layer)))
        out = first if out is None else out.unionByName(first)
        todo = _cut(todo.join(first.select("component"), "component", "left_anti"))
        left = _cut(left.join(first.select(F.col("component").alias("source")), "source", "left_anti"))
        layer += 1
    return parts.withColumn("layer", F.lit(0)) if out is None else parts.join(out, "component").select("node", "component", "layer")


def cycles(edges: DataFrame) -> DataFrame:
    """``component``, ``n_nodes`` and ``n_edges`` within, of every component that holds a cycle, a node that leads to itself among them."""
    parts = _cut(components(edges))
    a = parts.select(F.col("node").alias("source"), "component")
    b = parts.select(F.col("node").alias("target"), F.col("component").alias("other"))
    inside = _edges(edges).join(a, "source").join(b, "target").where("component = other").groupBy("component").agg(F.count("*").alias("n_edges"))
    return parts.groupBy("component").agg(F.count("*").alias("n_nodes")).join(inside, "component").select("component", "n_nodes", "n_edges")
