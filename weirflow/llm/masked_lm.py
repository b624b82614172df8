"""Masked pseudo-likelihood: a bidirectional window network scores documents.

Every token is predicted from the ``WINDOW`` tokens on either side, itself left out: the position's own share of
each neighbour's embedding is summed, squashed and read by a softmax of two levels (a class of tokens, then the
token in it). The score of a document is the sum of the logarithms of these conditional probabilities.

The most frequent words are tokens of the network; all others fall into hash buckets, and the probability of such a word is that of its bucket times its share of
it. The shares come from the counts of all words of the corpus, a table that grows with it and stays in Spark: the counts of the
``HEAD`` most frequent words go to the tasks, those of all others are joined to the words of each document. A
word that the corpus lacks gets a part of what its bucket leaves for words seen once.

The network is trained in numpy on all documents, each once, in ``ROUNDS`` parts by a hash of the text: in each
part every task starts from the same weights, takes gradient steps over its documents of that part and
returns its weights, which Spark averages by the tokens they saw. Only counts of words and weights are shuffled. The
driver holds the network, whose size is fixed.

Defined results: a null text and one without words have no tokens, a score of 0 and no mean; each input row gives one row, repeated rows equal ones; with an empty
corpus all words are unseen words of equal buckets and the untrained network scores them; words of equal counts are ordered by hash; other columns are ignored. Scores differ
with the partitions that the training saw (README).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.arrow import id_type, keyed_text, map_slices, shared_dir, slices
from weirflow.llm.wordhash import NOT_SPACE, U, joined, word_hashes, word_spans

WINDOW = 2
CLASSES = 32
VOCABULARY = CLASSES * CLASSES
BUCKETS = 256
WIDTH = 16
ROUNDS = 4
#: Most frequent words whose counts go to every task.
HEAD = 100_000
BATCH = 8192
#: Tokens of a step where a task has few.
LEAST_BATCH = 512
RATE = 0.15
#: Distinct words of a task that are counted at once before they go to the shuffle.
COUNTED = 400_000


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word."""
    data, offsets = joined(texts, lower=True)
    starts, ends, text = word_spans(data, offsets, NOT_SPACE)
    return word_hashes(data, starts, ends), text


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        words, of = np.unique(np.concatenate(held), return_inverse=True)
        n = np.bincount(of, np.concatenate(counts)).astype(np.int64)
        held.clear()
        counts.clear()
        return pa.record_batch([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            words, n = np.unique(tokens_of(part.column("text"))[0], return_counts=True)
            held.append(words)
            counts.append(n)
            if sum(map(len, held)) >= COUNTED:
                yield flush()
    if held:
        yield flush()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word (hash) and n of every word of the corpus."""
    return keyed_text(docs, id_col, text_col).select("text").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(table: DataFrame, most: int) -> tuple[list[tuple[int, int]], bool]:
    """Words and counts from a count on above which there are ``most`` words at most, and whether these are all words.

    The count is found from how many words there are by magnitude of their counts, so that no task sends more than is kept.
    """
    size = F.floor(F.ln("n") * 64)
    sizes = sorted(((r["size"], r["words"]) for r in table.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect()), reverse=True)
    held, least = 0, None
    for s, words in sizes:
        if held + words > most:
            break
        held, least = held + words, s
    if least is None:
        return [], not sizes
    return [(r["word"], r["n"]) for r in table.where(size >= least).collect()], least == sizes[-1][0]


@dataclass
class Network:
    """Weights by name; the words that have tokens of their own, sorted by hash, with their token numbers; and of the HEAD most frequent words hashes, sorted, and counts.

    ``held``, ``kinds`` and ``single`` tell of each bucket how often its words occur, how many there are and how many occur once.
    """

    weights: dict[str, np.ndarray]
    words: np.ndarray
    number: np.ndarray
    head: np.ndarray
    counts: np.ndarray
    held: np.ndarray
    kinds: np.ndarray
    single: np.ndarray
    table: DataFrame | None = None
    table_used: bool = False

    def shares(self, tokens: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithm of each word's share of its bucket (0 of a token of its own), and whether only the table of all counts knows it."""
        out = np.zeros(len(tokens))
        bucket = tokens - (VOCABULARY - BUCKETS)
        rare = np.flatnonzero(bucket >= 0)
        known = np.zeros(len(tokens), bool)
        if len(self.head):
            at = np.searchsorted(self.head, hashes[rare])
            at[at == len(self.head)] = 0
            same = self.head[at] == hashes[rare]
            known[rare[same]] = True
            b = bucket[rare[same]]
            out[rare[same]] = np.log(self.counts[at[same]] / (self.held + self.single)[b])
        unknown = rare[~known[rare]]
        out[unknown] = self.unseen()[bucket[unknown]]
        away = np.zeros(len(tokens), bool)
        away[unknown] = True
        return out, away

    def unseen(self) -> np.ndarray:
        """Of each bucket the logarithm of the share of a word that the corpus lacks."""
        return np.log(self.single / (self.held + self.single) / (self.kinds + 1))

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        out = (hashes % U(BUCKETS)).astype(np.int64) + (VOCABULARY - BUCKETS)
        if len(self.words):
            at = np.searchsorted(self.words, hashes)
            at[at == len(self.words)] = 0
            known = self.words[at] == hashes
            out[known] = self.number[at[known]]
        return out


def fresh(words: list[int], counts: Sequence[int] = (), buckets: dict[int, tuple[int, int, int]] | None = None) -> Network:
    """A network for words by falling frequency, with small random weights; tokens are numbered by frequency, so that classes hold tokens of like frequency."""
    rng = np.random.default_rng(0)
    w = {
        "embed": rng.normal(0, 0.3, (VOCABULARY + 1, WIDTH)), "place": np.ones((2 * WINDOW, WIDTH)) / np.sqrt(2 * WINDOW),
        "classes": rng.normal(0, 0.1, (CLASSES, WIDTH)), "class_bias": np.zeros(CLASSES), "inner": rng.normal(0, 0.1, (CLASSES, CLASSES, WIDTH)), "inner_bias": np.zeros((CLASSES, CLASSES)),
    }
    every = np.array(words, np.int64).view(U)
    h = every[: VOCABULARY - BUCKETS]
    order, by_hash = np.argsort(h), np.argsort(every)
    of = [(buckets or {}).get(b, (0, 0, 0)) for b in range(BUCKETS)]
    held, kinds, single = (np.array([x[j] for x in of], float) for j in range(3))
    # an untrained network gives each token its share of the corpus
    own = np.zeros(VOCABULARY - BUCKETS)
    own[: len(h)] = counts[: len(h)]
    often = (np.concatenate([own, held]) + 1).reshape(CLASSES, CLASSES)
    w["class_bias"], w["inner_bias"] = np.log(often.sum(1) / often.sum()), np.log(often / often.sum(1, keepdims=True))
    return Network({k: v.astype(np.float32) for k, v in w.items()}, h[order], order.astype(np.int64), every[by_hash], np.array(counts, float)[by_hash], held, kinds, np.maximum(single, 1))


def contexts(tokens: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The tokens around each one; VOCABULARY (an empty place) beyond the ends of its text."""
    n = len(tokens)
    padded = np.concatenate([np.full(WINDOW, VOCABULARY), tokens, np.full(WINDOW, VOCABULARY)])
    texts = np.concatenate([np.full(WINDOW, -1), text, np.full(WINDOW, -1)])
    steps = [s for s in range(2 * WINDOW + 1) if s != WINDOW]
    return np.stack([np.where(texts[s : s + n] == text, padded[s : s + n], VOCABULARY) for s in steps], 1)


def softmax(z: np.ndarray) -> np.ndarray:
    """Of each row; states are within one, so that sums stay far below the limit that keeps them finite."""
    z = np.exp(np.minimum(z, 60))
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def forward(w: dict[str, np.ndarray], around: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The embeddings of the tokens at each place, and the states."""
    near = [w["embed"][around[:, s]] for s in range(2 * WINDOW)]
    total = near[0] * w["place"][0]
    for s in range(1, 2 * WINDOW):
        total += near[s] * w["place"][s]
    return near, np.tanh(total)


def log_probabilities(w: dict[str, np.ndarray], tokens: np.ndarray, around: np.ndarray) -> np.ndarray:
    out = np.empty(len(tokens), np.float64)
    kind, inner = tokens // CLASSES, tokens % CLASSES
    for a in range(0, len(tokens), BATCH):
        part = slice(a, a + BATCH)
        k, i = kind[part], inner[part]
        h = forward(w, around[part])[1]
        p = np.log(softmax(h @ w["classes"].T + w["class_bias"])[np.arange(len(k)), k] + 1e-12)
        for c in np.unique(k):
            at = np.flatnonzero(k == c)
            p[at] += np.log(softmax(h[at] @ w["inner"][c].T + w["inner_bias"][c])[np.arange(len(at)), i[at]] + 1e-12)
        out[part] = p
    return out


class Trainer:
    """Gradient steps with a rate for each weight that falls with the squares of its gradients."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.copy() for k, v in weights.items()}
        self.seen = {k: np.full_like(v, 1e-2) for k, v in weights.items()}

    def step(self, name: str, gradient: np.ndarray, at: np.ndarray | int | None = None) -> None:
        where = slice(None) if at is None else at
        self.seen[name][where] += gradient * gradient
        self.w[name][where] -= RATE * gradient / np.sqrt(self.seen[name][where])

    def batch(self, tokens: np.ndarray, around: np.ndarray) -> None:
        w, n = self.w, len(tokens)
        kind, inner = tokens // CLASSES, tokens % CLASSES
        near, h = forward(w, around)
        p = softmax(h @ w["classes"].T + w["class_bias"])
        p[np.arange(n), kind] -= 1
        p /= n
        back = p @ w["classes"]
        for c in np.unique(kind):
            at = np.flatnonzero(kind == c)
            q = softmax(h[at] @ w["inner"][c].T + w["inner_bias"][c])
            q[np.arange(len(at)), inner[at]] -= 1
            q /= n
            back[at] += q @ w["inner"][c]
            self.step("inner", q.T @ h[at], c)
            self.step("inner_bias", q.sum(0), c)
        self.step("classes", p.T @ h)
        self.step("class_bias", p.sum(0))
        back *= 1 - h * h
        self.step("place", np.stack([(x * back).sum(0) for x in near]))
        everywhere = around.T.ravel()
        order = np.argsort(everywhere.astype(np.int16), kind="stable")
        flat, begin = np.unique(everywhere[order], return_index=True)
        moved = np.concatenate([back * x for x in w["place"]])
        total = np.add.reduceat(moved[order], begin, axis=0)
        self.step("embed", total, flat)


def trained(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights of this task after its whole share, times the tokens it saw, by name and row."""
    net: Network = shared.value
    own = Trainer(net.weights)
    seen = 0
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, text = tokens_of(part.column("text"))
            tokens = net.tokens(hashes)
            around = contexts(tokens, text)
            order = np.random.default_rng(len(tokens)).permutation(len(tokens))
            size = min(BATCH, max(LEAST_BATCH, len(tokens) // 8))
            for a in range(0, len(tokens), size):
                at = order[a : a + size]
                own.batch(tokens[at], around[at])
            seen += len(tokens)
    if seen:
        for name, w in own.w.items():
            flat = w.reshape(len(w), -1).astype(np.float64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array((flat * seen).ravel()))
            yield pa.record_batch([pa.array([name] * len(flat)), pa.array(range(len(flat)), pa.int32()), pa.array([seen] * len(flat), pa.int64()), values], names=["name", "row", "seen", "values"])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the weights by name and row of what a task holds, which is at most the network."""
    total: dict[tuple[str, int], tuple[int, np.ndarray]] = {}
    for batch in batches:
        lists = batch.column("values")
        for k, (name, row, seen) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("name", "row", "seen")), strict=True)):
            n, v = total.get((name, row), (0, 0.0))
            total[name, row] = n + seen, v + lists[k].values.to_numpy()
    if total:
        yield pa.record_batch([pa.array([k[0] for k in total]), pa.array([k[1] for k in total], pa.int32()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.list_(pa.float64()))], names=["name", "row", "seen", "values"])


WEIGHTS = "name string, row int, seen long, values array<double>"


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> Network:
    spark = docs.sparkSession
    shared_dir(spark)
    table = word_counts(docs, id_col, text_col).checkpoint()
    first = table.orderBy(F.desc("n"), "word").limit(VOCABULARY - BUCKETS).collect()
    own = [r["word"] for r in first]
    names = set(own)
    rest, whole = most_frequent(table, HEAD)
    head = [(r["word"], r["n"]) for r in first] + [(w, n) for w, n in rest if w not in names]
    # hashes are unsigned in numpy
    bucket = F.expr(f"cast(pmod(pmod(word, {BUCKETS}) + {BUCKETS}, {BUCKETS}) as int)").alias("bucket")
    rare = table.join(F.broadcast(spark.createDataFrame([(w,) for w in own], "word long")), "word", "left_anti")
    buckets = {r["bucket"]: (r["n"], r["kinds"], r["single"]) for r in rare.groupBy(bucket).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single")).collect()}
    net = fresh([w for w, _ in head], [n for _, n in head], buckets)
    source = keyed_text(docs, id_col, text_col).select("text")
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(net)
        part = source.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k)
        parts = part.mapInArrow(partial(trained, shared), WEIGHTS)
        # rows of the same weights meet by a hash of name and row: every task sums a part of the network over all shares
        sums = parts.repartition("name", "row").mapInArrow(summed, WEIGHTS)
        new = {n: np.zeros((len(v), v[0].size if v.ndim > 1 else 1)) for n, v in net.weights.items()}
        some = False
        for r in sums.toLocalIterator():
            new[r["name"]][r["row"]] = np.array(r["values"]) / r["seen"]
            some = True
        if some:
            net = replace(net, weights={n: new[n].reshape(v.shape).astype(np.float32) for n, v in net.weights.items()})
        shared.unpersist()
    net.table = None if whole else table
    return net


def scored(shared, batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, n_tokens, log-likelihood, and the words whose counts the tasks don't have: taken as unseen so far."""
    net: Network = shared.value
    hashes, text = tokens_of(batch.column("text"))
    tokens = net.tokens(hashes)
    n = np.bincount(text, minlength=batch.num_rows).astype(np.int64)
    total, away = np.zeros(batch.num_rows), np.zeros(0, bool)
    if len(tokens):
        share, away = net.shares(tokens, hashes)
        total = np.bincount(text, log_probabilities(net.weights, tokens, contexts(tokens, text)) + share, minlength=batch.num_rows)
    if net.table_used:
        offsets = np.zeros(batch.num_rows + 1, np.int32)
        np.cumsum(np.bincount(text[away], minlength=batch.num_rows) if len(away) else np.zeros(batch.num_rows), out=offsets[1:])
        words = pa.array(hashes[away].view(np.int64) if len(away) else np.zeros(0, np.int64))
    else:
        offsets, words = np.zeros(batch.num_rows + 1, np.int32), pa.array([], pa.int64())
    return pa.record_batch([batch.column("doc_id"), pa.array(n), pa.array(total, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), words)], names=["doc_id", "n_tokens", "log_likelihood", "words"])


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood and its mean for each row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(replace(net, table=None, table_used=net.table is not None))
    rows = map_slices(keyed_text(docs, id_col, text_col), partial(scored, shared), f"doc_id {id_type(docs, id_col)}, n_tokens long, log_likelihood double, words array<long>")
    if net.table is not None:
        rows = rows.withColumn("_row", F.monotonically_increasing_id()).checkpoint()  # numbers that stay
        unseen = ", ".join(f"{x:.12f}D" for x in net.unseen())
        total = ", ".join(f"{x:.1f}D" for x in net.held + net.single)
        bucket = f"cast(pmod(pmod(word, {BUCKETS}) + {BUCKETS}, {BUCKETS}) as int)"
        words = rows.select("_row", F.explode("words").alias("word")).groupBy("_row", "word").agg(F.count("*").alias("k"))
        gain = words.join(net.table, "word").selectExpr("_row", f"k * (ln(n / array({total})[{bucket}]) - array({unseen})[{bucket}]) as gain")
        gain = gain.groupBy("_row").agg(F.sum("gain").alias("gain"))
        rows = rows.join(gain, "_row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("gain", F.lit(0.0)))
    return rows.select("doc_id", "n_tokens", "log_likelihood", F.expr("if(n_tokens > 0, log_likelihood / n_tokens, null)").alias("mean_log_likelihood"))
