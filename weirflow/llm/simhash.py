"""SimHash near-duplicates, found by BK-trees over shards of the fingerprints.

A text, lower-cased in A-Z, is cut into words at space, tab, line feed, vertical tab, form feed and carriage return; its shingles are
all runs of ``WIDTH`` words joined by a space (of fewer words: all of them). A bit of the fingerprint is 1 if it is set in
over half of the shingles' XXH64 hashes (seed 42). Fingerprints of at most ``RADIUS`` different bits are linked; a class is what links reach.

Equal fingerprints are first folded into one. Cut into ``blocks`` parts, two linked fingerprints agree in ``blocks - RADIUS`` parts at least, so each
choice of as many parts makes a shard of the fingerprints that agree there, and every link lies within a shard. Each shard becomes a BK-tree: a node's
children are keyed by their integer Hamming distance to it, and a search follows only the edges within the radius of its own
distance. A shard of at most ``TREE`` fingerprints is one tree, built and searched in one task. A larger one is cut into trees of about that size;
these are broadcast, ``SET`` at a time, to all tasks that hold fingerprints of large shards, whatever their number. Tasks report no pairs but a
spanning forest of them, so a group of copies costs an edge a member and shard. Nothing is dropped and the result is exact for any ``blocks``; give 5 or 6 beyond 10^8 different
fingerprints, whose shards are finer.

Defined results: a null or empty text, or one without words, has fingerprint zero, which is linked like any other; every input row gives one row, repeated rows and ids too; a null
id keeps its row and takes the least id of its class, null if it has none; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.arrow import id_type, keyed_text, map_slices, shared_dir
from weirflow.llm.components import components

WIDTH = 3
SEED = 42
RADIUS = 3
BLOCKS = 4
#: Fingerprints of a tree, and trees of a broadcast (about 30 bytes a fingerprint).
TREE = 4096
SET = 64
#: Bytes of a text that are cut into words at once, members whose trees are built at once, and pairs of a search that are held at once.
PIECE = 1 << 20
MEMBERS = 1 << 16
PAIRS = 1 << 21
GAP = re.compile(rb"[\x20\x09-\x0D]")
#: The bits of each byte, from the lowest.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def hashes(text: bytes) -> Iterator[list[int]]:
    """The hashes of a text's shingles, a piece of the text after the other."""
    from xxhash import xxh64_intdigest

    at, held, some = 0, [], False
    while at < len(text):
        cut = GAP.search(text, min(at + PIECE, len(text)))
        end = cut.start() if cut else len(text)
        held += text[at:end].lower().split()  # of bytes: A-Z and the six characters only
        at = end
        if len(held) >= WIDTH:
            yield [xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(held[i:] for i in range(WIDTH)), strict=False))]
            held, some = held[len(held) - WIDTH + 1 :], True
    if held and not some:
        yield [xxh64_intdigest(b" ".join(held), SEED)]


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """The fingerprints of many texts, whose bits are counted together."""
    total, counts = np.zeros(len(texts), np.int64), np.zeros((len(texts), 64), np.int64)
    held, owner, size = [], [], 0

    def count() -> None:
        nonlocal size
        if held:
            who = np.repeat(np.array(owner), [len(h) for h in held])
            first, who = who[0], who - who[0]
            n = who[-1] + 1
            columns = np.concatenate([np.array(h, np.uint64) for h in held]).view(np.uint8).reshape(-1, 8)
            for k in range(8):  # least byte first
                counts[first : first + n, 8 * k : 8 * k + 8] += np.bincount(who * 256 + columns[:, k], minlength=n * 256).reshape(n, 256) @ BITS
            total[first : first + n] += np.bincount(who, minlength=n)
        held.clear()
        owner.clear()
        size = 0

    for i, t in enumerate(texts):
        for h in hashes(t):
            held.append(h)
            owner.append(i)
            size += len(h)
            if size > PIECE // 4:
                count()
    count()
    return ((2 * counts > total[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the fingerprint as a long."""
    rows = keyed_text(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = fingerprints_of([t.as_py() for t in batch.column("text")])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "print"])

    return map_slices(rows, run, f"doc_id {id_type(docs, id_col)}, print bigint")


class Trees(NamedTuple):
    """BK-trees side by side. Children are listed by ``parent * 65 + distance``, in which ``edges`` is sorted; ``nodes`` are their numbers."""

    prints: np.ndarray
    edges: np.ndarray
    nodes: np.ndarray


def build(prints: np.ndarray, tree: np.ndarray) -> tuple[Trees, np.ndarray]:
    """A BK-tree of each run of equal numbers in ``tree``, and the root of each print's tree.

    All trees grow a level at a time: the first print of a group is its node, the others are grouped anew by their distance to it.
    """
    fresh = lambda x: np.flatnonzero(np.r_[len(x) > 0, x[1:] != x[:-1]][: len(x)])
    at, key = np.arange(len(prints)), tree.astype(np.int64)
    starts = fresh(key)
    roots = np.repeat(starts, np.diff(np.r_[starts, len(prints)]))
    edges, nodes = [], []
    while len(at):
        starts = fresh(key)
        node = np.repeat(at[starts], np.diff(np.r_[starts, len(at)]))
        rest = at != node
        at, node = at[rest], node[rest]
        key = node * 65 + np.bitwise_count(prints[at] ^ prints[node])
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        starts = fresh(key)
        edges.append(key[starts])
        nodes.append(at[starts])
    edge, child = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edges, nodes))
    order = np.argsort(edge, kind="stable")
    return Trees(prints, edge[order], child[order]), roots


def search(trees: Trees, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of queries and of the nodes within the radius in the tree under each query's root."""
    todo = [(np.arange(len(queries)), roots)]
    while todo:
        who, node = todo.pop()
        if len(who) > PAIRS:
            todo += [(who[i : i + PAIRS // 2], node[i : i + PAIRS // 2]) for i in range(0, len(who), PAIRS // 2)]
            continue
        far = np.bitwise_count(queries[who] ^ trees.prints[node]).astype(np.int64)
        near = far <= radius
        if near.any():
            yield who[near], node[near]
        lo = np.searchsorted(trees.edges, node * 65 + np.maximum(far - radius, 0))
        hi = np.searchsorted(trees.edges, node * 65 + np.minimum(far + radius, 64), "right")
        n = hi - lo
        if n.any():
            place = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            todo.append((np.repeat(who, n), trees.nodes[place]))


def least_reached(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least number that each of n nodes reaches over the pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            off = x != y
            if not off.any():
                break
            a, b, x, y = a[off], b[off], x[off], y[off]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def grown(shard: np.ndarray, part: np.ndarray, large: np.ndarray, prints: np.ndarray, radius: int) -> pa.RecordBatch:
    """A spanning forest of the links within each tree, and the members of the trees of large shards with what each hangs on."""
    fresh = np.r_[True, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1])]
    tree = np.cumsum(fresh)
    trees, roots = build(prints, tree)
    least = least_reached(len(prints), search(trees, prints, roots, radius))
    hung = np.flatnonzero(least != np.arange(len(prints)))
    big = np.flatnonzero(fresh & large)
    ends = np.searchsorted(tree, tree[big], "right")
    n = len(hung)
    blank = lambda k, kind: pa.nulls(k, kind)
    signed = prints.view(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([pa.array(signed[hung]), blank(len(big), pa.int64())]),
            pa.concat_arrays([pa.array(signed[least[hung]]), blank(len(big), pa.int64())]),
            pa.concat_arrays([blank(n, pa.int64()), pa.array(shard[big])]),
            pa.concat_arrays([blank(n, pa.binary()), pa.array([signed[a:b].tobytes() for a, b in zip(big, ends, strict=True)], pa.binary())]),
        ],
        ["a", "b", "shard", "tree"],
    )


FOREST = "a bigint, b bigint, shard bigint, tree binary"


def shards(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``shard`` and ``print``: each fingerprint once for every choice of blocks that a linked one can share."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    part = lambda k: F.shiftrightunsigned("print", cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1))
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(n).cast("long")
        for k in chosen:
            key = F.shiftleft(key, cuts[k + 1] - cuts[k]).bitwiseOR(part(k))
        keys.append(key)
    return prints.select(F.explode(F.array(*keys)).alias("shard"), "print")


def forest(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree: int = TREE, together: int = SET) -> DataFrame:
    """Edges (a, b) between different fingerprints, whose components are those of all links; ``prints`` has one column of different fingerprints."""
    if not radius < blocks <= 12:
        raise ValueError("blocks must be more than the radius, and 12 at most")
    spark = prints.sparkSession
    shared_dir(spark)
    dealt = shards(prints, radius, blocks)
    large = dealt.groupBy("shard").count().where(F.col("count") > tree).select("shard", F.ceil(F.col("count") / tree).alias("parts")).checkpoint()
    any_large = not large.isEmpty()
    if any_large:
        dealt = dealt.join(large, "shard", "left").select("shard", F.coalesce(F.pmod(F.xxhash64("print"), "parts"), F.lit(0)).cast("int").alias("part"), F.col("parts").isNotNull().alias("large"), "print")
    else:
        dealt = dealt.select("shard", F.lit(0).alias("part"), F.lit(False).alias("large"), "print")
    dealt = dealt.repartition("shard", "part").sortWithinPartitions("shard", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.int32, bool, np.int64)
        held = [np.zeros(0, k) for k in kinds]
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            if len(held[0]) >= MEMBERS:
                last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))  # the last tree may go on
                if len(last):
                    done = [h[: last[-1] + 1] for h in held]
                    held = [h[last[-1] + 1 :] for h in held]
                    yield grown(*done[:3], done[3].view(np.uint64), radius)
        if len(held[0]):
            yield grown(*held[:3], held[3].view(np.uint64), radius)

    made = dealt.mapInArrow(run, FOREST).checkpoint()
    edges = made.where("tree is null").select("a", "b")
    if not any_large:
        return edges
    trees = made.where("tree is not null").select("shard", "tree", F.pmod(F.xxhash64("shard", "tree"), F.lit(1 << 30)).alias("at")).checkpoint()
    passes = max(1, -(-trees.count() // together))
    queries = dealt.where("large").select("shard", "print").checkpoint()
    for k in range(passes):
        share = trees.where(F.pmod("at", F.lit(passes)) == k).select("shard", "tree").collect()  # about SET trees
        edges = edges.unionByName(across(queries, {"shard": np.array([r["shard"] for r in share], np.int64), "trees": [bytes(r["tree"]) for r in share]}, radius))
    return edges


def across(queries: DataFrame, share: dict, radius: int) -> DataFrame:
    """Edges between fingerprints of large shards and what they touch in the broadcast trees of their shard, one for each group of a tree's members that its links hold together."""
    sent = queries.sparkSession.sparkContext.broadcast(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(sent.value["shard"], kind="stable")
        shard = sent.value["shard"][order]
        parts = [np.frombuffer(sent.value["trees"][i], np.uint64) for i in order]
        if not parts:
            return
        trees, roots = build(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
        least = least_reached(len(roots), search(trees, trees.prints, roots, radius))
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        for batch in batches:
            key, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            lo, hi = np.searchsorted(shard, key), np.searchsorted(shard, key, "right")
            n = hi - lo
            who = np.repeat(np.arange(len(key)), n)
            tree = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            prints = prints.view(np.uint64)
            for a, b in search(trees, prints[who], starts[tree], radius):
                made = np.unique(np.stack([prints[who[a]], trees.prints[least[b]]], 1), axis=0)
                made = made[made[:, 0] != made[:, 1]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["a", "b"])

    return queries.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int = BLOCKS, tree: int = TREE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the least id of the document's class."""
    shared_dir(docs.sparkSession)
    rows = fingerprints(docs, id_col, text_col).checkpoint()
    least = rows.groupBy("print").agg(F.min("doc_id").alias("least")).checkpoint()
    roots = components(forest(least.select("print"), radius, blocks, tree)).checkpoint()
    hung = least.join(roots, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("root", "print").alias("root")).checkpoint()
    classes = hung.groupBy("root").agg(F.min("least").alias("component_id")).checkpoint()
    named = hung.select("print", "root").join(classes, "root").select("print", "component_id").checkpoint()
    return rows.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
