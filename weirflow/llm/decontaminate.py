"""Benchmark decontamination by winnowing.

Every benchmark item gives windows of ``WINDOW`` consecutive words (an item of fewer words is one window). Of
the k-gram hashes of a window only the minimum is kept as a fingerprint, for items and documents alike, with
k + w - 1 = WINDOW; so any shared window shares a fingerprint. Documents' fingerprints are joined with the
items', hits are extended to the windows around them, and each window is compared word by word.

Long items are cut in the tasks into pieces of ``PIECE`` words that overlap by a window less a word, so that they hold the same windows, and
repeated pieces count once. Pieces go to the executors in blocks of a bounded size; each block is a pass over the documents that
shuffles no text. One block holds far more than the usual benchmark, and then nothing is shuffled at all.

Defined results: a null text has no words; an item with a null id or without words is left out; rows that
repeat an item_id count as one item; each input row gives one row, repeated rows give equal rows; columns
besides the two that are named are ignored; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.arrow import id_type, keyed_text, map_slices, shared_dir
from weirflow.llm.wordhash import LOWER_ALNUM, NONE, U, gram_hashes, joined, word_hashes, word_spans

WINDOW = 10
GRAM = 5
#: Characters of benchmark text in a block; its index takes some 30 bytes a character on each Python worker.
BLOCK_CHARS = 2_000_000
PIECE = 2000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


@dataclass
class Index:
    """Of a block of items: fingerprints, the hashes of all windows, and who holds which window."""

    prints: np.ndarray
    filter: np.ndarray
    hashes: dict[int, np.ndarray]
    holders: dict[bytes, tuple[int, ...]]
    items: list[str] = field(default_factory=list)


def minima(grams: np.ndarray) -> np.ndarray:
    """Whether a gram is the least of a run of WINDOW - GRAM + 1 grams that it lies in; equal ones all count."""
    w = WINDOW - GRAM + 1
    least = np.concatenate([grams, np.full(w - 1, NONE, U)])
    low = least[: len(grams)].copy()
    for j in range(1, w):
        np.minimum(low, least[j : j + len(grams)], out=low)
    chosen = np.zeros(len(grams), bool)
    for j in range(min(w, len(grams))):
        chosen[j:] |= grams[j:] == low[: len(grams) - j]
    return chosen & (grams != NONE)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = joined(texts, lower=True)
    starts, ends, text = word_spans(data, offsets, LOWER_ALNUM)
    return data, starts, ends, text, word_hashes(data, starts, ends)


def build_index(rows: list[tuple[str, str]]) -> Index:
    ids = sorted({i for i, _ in rows})
    number = {x: k for k, x in enumerate(ids)}
    data, starts, ends, text, hashes = words_of(pa.array([t for _, t in rows], pa.string()))
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    first = np.searchsorted(text, np.arange(len(rows) + 1))
    grams = gram_hashes(hashes, text, GRAM)
    prints = np.unique(grams[minima(grams)])
    holders: dict[bytes, set[int]] = {}
    lengths = {WINDOW}
    for k, (item, _) in enumerate(rows):
        own = words[first[k] : first[k + 1]]
        n = min(WINDOW, len(own))
        if n:
            lengths.add(n)
            for j in range(len(own) - n + 1):
                holders.setdefault(b" ".join(own[j : j + n]), set()).add(number[item])
    counts = np.diff(first)
    of: dict[int, np.ndarray] = {}
    for n in sorted(lengths):
        h = gram_hashes(hashes, text, n)
        fits = counts[text] == n if n < WINDOW else np.ones(len(text), bool)
        of[n] = np.unique(h[(h != NONE) & fits])
    marks = np.zeros(1 << 20, bool)
    marks[prints >> U(44)] = True
    return Index(prints, marks, of, {k: tuple(sorted(v)) for k, v in holders.items()}, ids)


def among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(values), bool)
    at = np.searchsorted(held, values)
    at[at == len(held)] = 0
    return held[at] == values


def windows_hit(index: Index, hashes: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """First word and length of each window whose hash an item has."""
    found: list[tuple[int, int]] = []
    grams = gram_hashes(hashes, text, GRAM)
    at = np.flatnonzero(minima(grams) & index.filter[grams >> U(44)])
    at = at[among(grams[at], index.prints)]
    if len(at):
        around = np.unique((at[:, None] - np.arange(WINDOW - GRAM + 1)[None, :]).ravel())
        around = around[around >= 0]
        whole = gram_hashes(hashes, text, WINDOW)[around]
        found += [(int(s), WINDOW) for s in around[(whole != NONE) & among(whole, index.hashes[WINDOW])]]
    for n, held in index.hashes.items():
        if n < WINDOW and len(held):  # items too short for a fingerprint of their own
            h = gram_hashes(hashes, text, n)
            found += [(int(s), n) for s in np.flatnonzero((h != NONE) & among(h, held))]
    return found


def search(shared, batch: pa.RecordBatch) -> pa.RecordBatch:
    """For each text: its words, the spans of words hit and the items found."""
    index: Index = shared.value
    data, starts, ends, text, hashes = words_of(batch.column("text"))
    n = np.bincount(text, minlength=batch.num_rows) if len(text) else np.zeros(batch.num_rows, np.int64)
    first = np.searchsorted(text, np.arange(batch.num_rows))
    spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
    items: list[set[int]] = [set() for _ in range(batch.num_rows)]
    for s, k in windows_hit(index, hashes, text):
        key = b" ".join(data[a:b].tobytes() for a, b in zip(starts[s : s + k].tolist(), ends[s : s + k].tolist(), strict=True))
        if own := index.holders.get(key):
            t = int(text[s])
            items[t].update(own)
            at = int(s - first[t])
            spans[t].append({"first": at, "last": at + k - 1})
    return pa.record_batch(
        [batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array([merged(x) for x in spans], SPANS), pa.array([[index.items[i] for i in sorted(x)] for x in items], pa.list_(pa.string()))],
        names=["doc_id", "key", "n_words", "spans", "items"],
    )


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: x["first"]):
        if out and x["first"] <= out[-1]["last"] + 1:
            out[-1] = {"first": out[-1]["first"], "last": max(out[-1]["last"], x["last"])}
        else:
            out.append(x)
    return out


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each item in pieces that together have its windows."""
    for batch in batches:
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = WORD.findall(text.translate(UPPER))
            cut = [" ".join(words[a : a + PIECE + WINDOW - 1]) for a in range(0, max(1, len(words) - WINDOW + 1), PIECE)]
            yield pa.record_batch([pa.array([item] * len(cut)), pa.array(cut)], names=["item", "text"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, spans of words hit (word numbers, ends included) and items, sorted."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null")
    items = items.mapInArrow(pieces, "item string, text string").where("text <> ''").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + int(chars) // block_chars
    source = keyed_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("key"), "text")
    schema = f"doc_id {id_type(docs, id_col)}, key long, n_words long, spans array<struct<first: long, last: long>>, items array<string>"
    parts = []
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(build_index([(r[0], r[1]) for r in own.toLocalIterator()]))
        parts.append(map_slices(source, partial(search, index), schema))
    if blocks == 1:
        return parts[0].drop("key")
    shared_dir(spark)
    parts[0] = parts[0].checkpoint()
    one = lambda part: part.where("size(items) > 0").dropDuplicates(["doc_id", "key"])  # noqa: E731  # so that a group has a row for each block at most
    found = one(parts[0])
    for part in parts[1:]:
        found = found.unionByName(one(part))
    found = found.groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined_spans = F.expr(
        "aggregate(spans, cast(array() as array<struct<first: bigint, last: bigint>>), (a, x) -> if(size(a) > 0 and x.first <= element_at(a, -1).last + 1, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, x.last)))), concat(a, array(x))))"
    )
    found = found.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), joined_spans.alias("spans"), "items")
    base = parts[0].select("doc_id", "key", "n_words")
    return base.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left").select(
        "doc_id", "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<first: bigint, last: bigint>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose texts hold no window of an item, with all their columns; decided row by row, also where ids are null or repeated."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("text"))
    found = contamination(rows, benchmark, "_row", "text", item_col, item_text_col, block_chars)
    return found.where("size(items) = 0").select("doc_id.*")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query, from those of contamination()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))



def oracle() -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
n AS (SELECT item, w, least({WINDOW}, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM n)),
ks AS (SELECT DISTINCT k FROM n),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
hit AS (SELECT r, item, i, dw.k FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""
