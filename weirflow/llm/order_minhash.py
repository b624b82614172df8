"""Near-duplicate detection by Order MinHash.

A text is its sequence of five-word shingles, each labelled with how often it occurred before. For each of
``TABLES`` hash functions the ``ORDER`` least labelled shingles are sampled and kept in the order of the text; together they are
a key, so that texts share keys as their edit similarity allows. Texts with repeated shingles get keys of
their first occurrences too, so that texts that differ in repeats only meet as well. At a similarity of 0.8
a table's keys agree with a chance of about 0.8 ** ORDER; none of ``TABLES`` does for about two pairs in a thousand million.

All work is on texts by their digest: exact copies are one text from the start, and an id that occurs with several texts
stands in the class of each. Texts that share a key are a bucket. First, each member of a bucket is compared
with its leaders: of each of ``SHARES`` parts of a bucket the text that stands in the largest buckets (nearest to what the
others were copied from) and one by a hash. Verified links are joined to classes, and what is then left are pairs of
a bucket whose texts are of different classes. They are all looked at, in blocks of about ``BLOCK`` texts of a bucket: tasks
compare the numbers of shingles and the bits that these mark in numpy and give only the pairs that can be similar.
Texts of buckets of more than ``WIDE`` texts whose largest class leaves more than a block meet by their rarest shingles
instead: in any order of all shingles, two sets at 0.8 have one in common among the first fifth of the larger and the first
ninth of the smaller, so no pair is lost, and what is common to very many texts comes last. Where very many texts of several
classes have their rarest shingles in common as well, all their pairs are looked at in blocks.

Candidates are verified by a banded alignment: the longest common subsequence c of the labelled shingles within
the band that a similarity of 0.8 allows, against c / (|A| + |B| - c) >= 0.8, or the same of the first occurrences.

Defined results: each input row gives one row; null texts and texts without words are alone in their class, whose id is their own;
texts of fewer than five words are one shingle; class_id is the least id that a class has (null if it has none), so
classes that share an id by one of its several texts can show the same number; other columns are ignored; an
empty table gives an empty result. Ties between leaders are settled by digest.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.arrow import id_type, keyed_text, map_slices, shared_dir, slices
from weirflow.llm.components import components
from weirflow.llm.wordhash import NONE, NOT_SPACE, U, gram_hashes, joined, mix, word_hashes, word_spans

SHINGLE = 5
SIMILARITY = 0.8
TABLES = 20
ORDER = 2
#: Parts of a bucket by a hash of the text in the first round; each has a central leader and another.
SHARES = 2
#: Texts of a bucket that a task compares with one another, or with as many others.
BLOCK = 1024
#: Texts of a bucket beyond which they meet by their rarest shingles.
WIDE = 4096
#: Slots in which the shingles of such texts are counted; the counts (4 MB) go to the tasks and put the shingles in order.
SLOTS = 1 << 20
#: Texts with a rare shingle in common up to which marks are compared once for each pair, not wherever it meets.
FEW = 64
#: Sets the shingles of texts with repeats apart from the first occurrences.
REPEATED = U(0xA0761D6478BD642F)
#: Words of 64 bits whose bits the shingles mark, so that common ones can be counted from above.
MARKS = 32
#: Rows that a task compares at once, besides the rest of a block.
AT_ONCE = 4096
SEEDS = mix(np.arange(1, TABLES + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def shingle_hashes(words: np.ndarray, text: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hash of the shingle at each word; NONE where none begins."""
    grams = gram_hashes(words, text, SHINGLE)
    first = np.cumsum(counts) - counts
    for n in range(1, SHINGLE):
        short = first[counts == n]
        if len(short):
            grams[short] = gram_hashes(words, text, n)[short]
    return grams


def occurrences(grams: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often the text had the same shingle before."""
    order = np.lexsort((grams, text))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (grams[order][1:] != grams[order][:-1]) | (text[order][1:] != text[order][:-1])
    at = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return out


def order_keys(items: np.ndarray, grams: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have items, and a key of each in each table. ``items`` are hashes of labelled shingles, ``grams`` of bare ones."""
    some, begin = np.unique(text, return_index=True)
    place = np.searchsorted(some, text)
    padded = np.append(grams, NONE)
    keys = np.empty((len(some), TABLES), U)
    for t in range(TABLES):
        values = mix(items ^ SEEDS[t])
        chosen = np.full((len(some), ORDER), len(grams), np.int64)
        for j in range(ORDER):
            low = np.minimum.reduceat(values, begin)
            hit = np.flatnonzero((values == low[place]) & (values != NONE))
            who, at = np.unique(place[hit], return_index=True)
            chosen[who, j] = hit[at]
            values[hit[at]] = NONE
        chosen.sort(axis=1)  # the order of the text
        key = np.full(len(some), SEEDS[t], U)
        for j in range(ORDER):
            key = mix(key ^ padded[chosen[:, j]]) * U(3)
        keys[:, t] = key
    return some, keys


def keys_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each text whether it has words, its numbers of distinct and of all shingles, the bits that they mark, and its keys."""
    n = len(texts)
    data, offsets = joined(texts, lower=False)
    starts, ends, text = word_spans(data, offsets, NOT_SPACE)
    counts = np.bincount(text, minlength=n).astype(np.int64)
    grams = shingle_hashes(word_hashes(data, starts, ends), text, counts)
    use = grams != NONE
    grams, text = grams[use], text[use]
    totals = np.bincount(text, minlength=n).astype(np.int64)
    flags = np.zeros((n, MARKS * 64), bool)
    keys: list[np.ndarray] = [np.zeros(0, U)] * n
    if not len(grams):
        return counts > 0, totals, totals, np.packbits(flags, axis=1).view(U), keys
    flags[text, (mix(grams) % U(MARKS * 64)).astype(np.int64)] = True
    before = occurrences(grams, text)
    sizes = np.bincount(text[before == 0], minlength=n).astype(np.int64)
    items = mix(grams + mix(before.astype(U)))
    for i, own in zip(*order_keys(items, grams, text), strict=True):
        keys[i] = own
    again = (before == 0) & (sizes < totals)[text]
    if again.any():
        for i, own in zip(*order_keys(items[again], grams[again], text[again]), strict=True):
            keys[i] = np.unique(np.concatenate([keys[i], own]))
    return counts > 0, sizes, totals, np.packbits(flags, axis=1).view(U), keys


def lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, U)]).view(np.int64)))


def sketched(batch: pa.RecordBatch) -> pa.RecordBatch:
    some, sizes, totals, marks, keys = keys_of(batch.column("text"))
    digests = [d if s else None for d, s in zip(batch.column("digest").to_pylist(), some.tolist(), strict=True)]
    return pa.record_batch([batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes), pa.array(totals), pa.array([m.tobytes() for m in marks], pa.binary()), lists(keys)], names=["doc_id", "digest", "size", "total", "marks", "keys"])


def text_digest(text: Column) -> Column:
    """Sixteen bytes that stand for a text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def with_digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed_text(docs, id_col, text_col).withColumn("digest", text_digest(F.col("text")))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest of the text (null if it has no words), its numbers of distinct and of all shingles, the bits that they mark and its keys."""
    return map_slices(with_digest(docs, id_col, text_col), sketched, f"doc_id {id_type(docs, id_col)}, digest binary, size long, total long, marks binary, keys array<long>")


def sequences(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the hashes of its labelled shingles in order, and which of them are first occurrences."""
    n = len(texts)
    data, offsets = joined(texts, lower=False)
    starts, ends, text = word_spans(data, offsets, NOT_SPACE)
    grams = shingle_hashes(word_hashes(data, starts, ends), text, np.bincount(text, minlength=n).astype(np.int64))
    use = grams != NONE
    grams, text = grams[use], text[use]
    before = occurrences(grams, text) if len(grams) else np.zeros(0, np.int64)
    items, first = mix(grams + mix(before.astype(U))), before == 0
    cut = np.searchsorted(text, np.arange(n + 1))
    return [(items[a:b], first[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """The similarity of two sequences without repeats by their longest common subsequence, 0 if below the least.

    A similarity s leaves at most (1 / s - 1) * min(|A|, |B|) items of both unmatched, and no item can be
    shifted by more; matches outside that band are not looked at.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    band = (1 / similarity - 1) * min(n, m) + 1e-9
    if abs(n - m) > band:
        return 0.0
    order = np.argsort(a)
    at = np.searchsorted(a[order], b)
    at[at == n] = 0
    places = order[at]
    places = places[(a[places] == b) & (np.abs(places - np.arange(m)) <= band)]  # where the items of b stand in a
    c = len(places)
    if c < similarity * (n + m - c):
        return 0.0
    if (np.diff(places) < 0).any():
        tails: list[int] = []
        for i in places.tolist():
            k = bisect_left(tails, i)
            if k == len(tails):
                tails.append(i)
            else:
                tails[k] = i
        c = len(tails)
    found = c / (n + m - c)
    return found if found >= similarity else 0.0


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether two texts, as sequences() has them, are near duplicates: by all shingles or by their first occurrences."""
    if aligned(a[0], b[0]):
        return True
    return not (a[1].all() and b[1].all()) and aligned(a[0][a[1]], b[0][b[1]]) > 0


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, text_a, text_b) that are similar enough."""
    for batch in batches:
        for part in slices(batch, "text_b"):
            names = part.column("a").to_pylist()
            fresh = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]  # a text stands in consecutive pairs
            of_a = sequences(part.column("text_a").take(pa.array(fresh, pa.int64())))
            which = np.searchsorted(fresh, np.arange(len(names)), "right") - 1
            keep = pa.array([k for k, b in enumerate(sequences(part.column("text_b"))) if similar(of_a[which[k]], b)], pa.int64())
            yield pa.record_batch([part.column("a").take(keep), part.column("b").take(keep)], names=["a", "b"])


def members(texts: DataFrame) -> DataFrame:
    """node, size, total, weight and key of each text in each bucket that several share; weight is how much its buckets hold."""
    rows = texts.select("node", "size", "total", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(sizes, "key")
    central = shared.groupBy("node", "size", "total").agg(F.sum("n").alias("weight"), F.collect_list("key").alias("keys"))  # at most 2 * TABLES keys of a text
    return central.select("node", "size", "total", "weight", F.explode("keys").alias("key")).checkpoint()


def near(a: str, b: str) -> str:
    """Whether numbers of shingles leave one of the similarities possible."""
    return " or ".join(f"({a}{c} >= {SIMILARITY} * {b}{c} - 1e-6 and {b}{c} >= {SIMILARITY} * {a}{c} - 1e-6)" for c in ("size", "total"))


def paired(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def led(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a bucket's leaders and its other texts."""
    whole = F.struct("node", "size", "total")
    share = F.pmod(F.xxhash64("node"), F.lit(SHARES)).alias("share")
    best = rows.groupBy("key", share).agg(F.min(F.struct(-F.col("weight"), "node", whole.alias("l"))).alias("r"), F.min(F.struct(F.xxhash64("node", "key"), "node", whole.alias("l"))).alias("h"))
    leaders = best.select("key", F.explode(F.array_distinct(F.array("r.l", "h.l"))).alias("l")).checkpoint()
    pairs = rows.join(leaders, "key").where(f"l.node <> node and ({near('l.', '')})")
    return pairs.select(*paired("l.node", "node")).distinct()


def counted(rows: DataFrame) -> DataFrame:
    """Of each key with several classes and a ``full`` row: its texts, its largest class (``main``), how many texts are outside it and how many are full."""
    sizes = rows.groupBy("key", "class").agg(F.count("*").alias("n"), F.count_if("full").alias("full"))
    top = sizes.groupBy("key").agg(F.sum("n").alias("texts"), F.max(F.struct("n", "class")).alias("top"), F.count("*").alias("classes"), F.sum("full").alias("fulls")).where("classes > 1 and fulls > 0")
    return top.select("key", "texts", "fulls", F.col("top.class").alias("main"), (F.col("texts") - F.col("top.n")).alias("outside"))


def blocks(rows: DataFrame) -> DataFrame:
    """g, side, node, class, full and texts of the rows of each block: any two texts of a key of which one is outside its largest class and one is full meet in one.

    Texts of sides 0 and 1 are for those of the other side, texts of side 2 for all. If few are outside, or full, they go to every block of the
    others (that many / BLOCK rows more for each text); many meet by pairs of blocks, so each is in ``texts`` / BLOCK of them.
    """
    n = F.ceil(F.col("texts") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    every = F.sequence(F.lit(0), n - 1)
    outer = F.when(F.col("fulls") < F.col("outside"), F.col("full")).otherwise(F.col("class") != F.col("main"))
    few = F.when(outer, F.transform(every, lambda i: F.struct(i.alias("i"), i.alias("j"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(own.alias("i"), own.alias("j"), F.lit(0).alias("side"))))
    many = F.transform(every, lambda i: F.struct(F.least(i, own).alias("i"), F.greatest(i, own).alias("j"), F.when(i == own, 2).when(own < i, 0).otherwise(1).alias("side")))
    placed = rows.withColumn("p", F.explode(F.when(F.least("fulls", "outside") <= BLOCK, few).otherwise(many)))
    return placed.select(F.xxhash64("key", "p.i", "p.j").alias("g"), "p.side", "node", F.xxhash64("class").alias("class"), "full", "texts")


def left_over(rows: DataFrame, texts: DataFrame, roots: DataFrame, held: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a bucket whose texts are of different classes and can be similar by their numbers and marks."""
    classed = rows.select("node", "key").join(roots.withColumnRenamed("root", "class"), "node", "left").select("node", "key", F.coalesce("class", "node").alias("class"), F.lit(True).alias("full"))
    now = classed.join(counted(classed), "key").checkpoint()
    fits = f"texts <= {WIDE} or outside <= {BLOCK}"
    found = met(blocks(now.where(fits)), texts, 0)
    wide = now.where(f"not ({fits})").select("node", "class").distinct().checkpoint()
    return found if wide.isEmpty() else found.unionByName(sharing_rare(wide, texts, held)).distinct()


def met(placed: DataFrame, texts: DataFrame, few: int) -> DataFrame:
    """Distinct pairs (a, b) of a block that are possible; where a key has up to ``few`` texts, by their numbers alone."""
    marks = F.when(F.col("texts") > few, F.col("marks")).alias("marks")
    rows = placed.join(texts.select("node", "size", "total", "marks"), "node").select("g", "side", "node", "class", "full", "size", "total", marks)
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(compared, "a binary, b binary").select(*paired("a", "b")).distinct()


def sharing_rare(wide: DataFrame, texts: DataFrame, held: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of the texts of ``wide`` (node, class) that are of different classes and can be similar: all of them, whatever keys they have."""
    own = held.join(wide, "node").select("node", "text", F.xxhash64("class").alias("class")).checkpoint()
    seen = own.mapInArrow(tallied, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # a row for each of SLOTS at most
    counts = np.zeros(SLOTS, np.int32)
    counts[seen.column("slot").to_numpy()] = np.minimum(seen.column("n").to_numpy(), 0x7FFFFFFF)
    rare = own.mapInArrow(rarest(own.sparkSession.sparkContext.broadcast(counts)), "node binary, class long, key long, full boolean").checkpoint()
    pairs = met(blocks(rare.join(counted(rare), "key")), texts, FEW)
    for c in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("size", "total", "marks")]), c)
    return pairs.mapInArrow(marked_alike, "a binary, b binary")


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many labelled shingles of a task's texts fall in each slot."""
    n = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            for items, _ in sequences(part.column("text")):
                np.add.at(n, (items % U(SLOTS)).astype(np.int64), 1)
    at = np.flatnonzero(n)
    yield pa.record_batch([pa.array(at), pa.array(n[at])], names=["slot", "n"])


def rarest(sent: Broadcast[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that gives the keys by which texts (node, class, text) meet: of n shingles those that come first by their slots' counts (``sent``).

    Sets of n <= m shingles at s have at least s / (1 + s) * (n + m) in common. So one is among all but that many, less one, of either;
    with m <= n / s that is within the first n - 2 * s / (1 + s) * n + 1 of the smaller (``full``) and m - s * m + 1 of the larger.
    Texts meet by first occurrences, those with repeats by all shingles too: a text without repeats has as much in common with first occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                who, keys, full = [], [], []
                for k, (items, first) in enumerate(sequences(part.column("text"))):
                    for own, apart in ((items[first], U(0)), (items if not first.all() else items[:0], REPEATED)):
                        n, seen = len(own), counts[(own % U(SLOTS)).astype(np.int64)]
                        order = np.lexsort((own, seen))[: n - ceil(SIMILARITY * n - 1e-6) + 1]
                        inner = np.arange(len(order)) < n - ceil(2 * SIMILARITY / (1 + SIMILARITY) * n - 1e-6) + 1
                        use = seen[order] > 1  # others are in no second text
                        who.append(np.full(int(use.sum()), k))
                        keys.append(mix(own[order[use]] ^ apart))
                        full.append(inner[use])
                at = pa.array(np.concatenate(who))
                yield pa.record_batch([part.column("node").take(at), part.column("class").take(at), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(full))], names=["node", "class", "key", "full"])

    return run


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of rows of one block, sorted by it, whose classes differ and whose numbers and marks leave the similarity possible."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            held = part if held is None else pa.concat_batches([held, part])
            g = held.column("g").to_numpy()
            whole = int(np.searchsorted(g, g[-1]))  # the last block may go on
            if whole:
                yield possible(held.slice(0, whole))
                held = held.slice(whole)
    if held is not None and held.num_rows:
        yield possible(held)


def marks_of(column: pa.Array) -> np.ndarray:
    """The marks of each row; none where they are null, which leaves every pair possible."""
    return np.frombuffer(b"".join(m or bytes(MARKS * 8) for m in column.to_pylist()), U).reshape(-1, MARKS)


def unmarked(size: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """How many shingles of each row mark no bit of their own."""
    return size - np.bitwise_count(marks).sum(1, dtype=np.int64)


def alike(size: np.ndarray, total: np.ndarray, marks: np.ndarray, spare: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the numbers and marks of rows x and y leave one of the similarities possible."""
    more = total - size
    common = np.minimum(spare[x], spare[y]) + np.bitwise_count(marks[x] & marks[y]).sum(1, dtype=np.int64)
    by_first = (1 + SIMILARITY) * common >= SIMILARITY * (size[x] + size[y]) - 1e-6
    by_all = (1 + SIMILARITY) * (common + np.minimum(more[x], more[y])) >= SIMILARITY * (total[x] + total[y]) - 1e-6
    return by_first | by_all


def marked_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, with size, total and marks of both) that their numbers and marks leave possible."""
    for batch in batches:
        if not (n := batch.num_rows):
            continue
        size, total = (np.concatenate([batch.column(f"{x}_{c}").to_numpy() for c in ("a", "b")]) for x in ("size", "total"))
        marks = np.concatenate([marks_of(batch.column(f"marks_{c}")) for c in ("a", "b")])
        keep = pa.array(np.flatnonzero(alike(size, total, marks, unmarked(size, marks), np.arange(n), np.arange(n, 2 * n))))
        yield pa.record_batch([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])


def possible(rows: pa.RecordBatch) -> pa.RecordBatch:
    g, side, kind, size, total = (rows.column(c).to_numpy() for c in ("g", "side", "class", "size", "total"))
    full = rows.column("full").to_numpy(zero_copy_only=False)
    marks = marks_of(rows.column("marks"))
    spare = unmarked(size, marks)
    more = total - size
    first, second = [], []
    at = np.arange(len(g))
    for step in range(1, len(g)):
        at = at[at + step < len(g)]
        at = at[g[at] == g[at + step]]
        if not len(at):
            break
        b = at + step
        ok = (kind[at] != kind[b]) & ((side[at] != side[b]) | (side[at] == 2)) & (full[at] | full[b])
        for x in (size, total):
            ok &= (np.minimum(x[at], x[b]) >= SIMILARITY * np.maximum(x[at], x[b]) - 1e-6) | (more[at] + more[b] > 0)
        x, y = at[ok], b[ok]
        can = alike(size, total, marks, spare, x, y)
        first.append(x[can])
        second.append(y[can])
    node = rows.column("node")
    pick = lambda parts: node.take(pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), pa.int64()))
    return pa.record_batch([pick(first), pick(second)], names=["a", "b"])


def confirmed(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs that the alignment of their texts (held: node, text) confirms."""
    both = pairs.join(held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(verified, "a binary, b binary")


def classes_of(docs: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node and root (the least digest of its class) of the texts that have a near duplicate. ``texts``: node, size, total, marks and keys, one row each."""
    rows = members(texts)
    # one copy of a text leaves each task, so that a text of very many rows is read once
    one = with_digest(docs, id_col, text_col).groupBy(F.col("digest").alias("node")).agg(F.first("text").alias("text"))
    held = one.join(rows.select("node").distinct(), "node", "left_semi").checkpoint()
    tried = led(rows).checkpoint()
    links = confirmed(tried, held).checkpoint()
    roots = components(links).checkpoint()
    more = left_over(rows, texts, roots, held).join(tried, ["a", "b"], "left_anti").checkpoint()
    late = confirmed(more, held).checkpoint()
    if late.isEmpty():
        return roots
    return components(late.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (null without words) and root of each row; root is null where there are no words."""
    shared_dir(docs.sparkSession)
    rows = sketches(docs, id_col, text_col).checkpoint()
    texts = rows.where("digest is not null").groupBy(F.col("digest").alias("node")).agg(*[F.first(c).alias(c) for c in ("size", "total", "marks", "keys")]).checkpoint()
    roots = classes_of(docs, texts, id_col, text_col)
    return rows.select("doc_id", "digest").join(roots, F.col("digest") == F.col("node"), "left").select("doc_id", "digest", F.coalesce("root", "digest").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id (the least id of its class) of each row."""
    rows = classified(docs, id_col, text_col).checkpoint()
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("root", "least").checkpoint()  # Spark splits the rows of a large class between two plain shuffles only
    return rows.join(least, "root", "left").select("doc_id", F.coalesce("least", "doc_id").alias("class_id"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that with the least id, of equal ids the least digest, of equal rows any. Rows without words stay.

    Decided by row: of an id that occurs with several texts, only rows go whose own text is represented by another row.
    """
    rows = classified(docs, id_col, text_col).where("root is not null").checkpoint()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    best = rows.groupBy("root").agg(F.min(order).alias("best")).select("root", F.col("best.doc_id").alias("_id"), F.col("best.digest").alias("_digest")).checkpoint()
    rows = rows.join(best, "root").withColumn("wins", F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    counts = rows.groupBy("doc_id", "digest").agg(F.first("wins").alias("wins"), F.count("*").alias("n"))
    counts = counts.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "wins", "n").checkpoint()
    made = with_digest(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("text")), "_row", "text")
    made = made.select(F.col("doc_id").alias("_row"), F.col(f"doc_id.{id_col}").alias("_doc"), "digest")
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    kept = made.join(counts.where("not wins").select("_id", "_digest"), same, "left_anti")
    again = counts.where("wins and n > 1").select("_id", "_digest")
    if again.isEmpty():
        return kept.select("_row.*")
    once = kept.join(again, same, "left_semi").dropDuplicates(["_doc", "digest"])
    return kept.join(again, same, "left_anti").unionByName(once).select("_row.*")
