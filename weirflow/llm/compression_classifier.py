"""A quality classifier by compression.

Two zstandard dictionaries are built, of text labelled good and of text labelled bad. A text is cut into
blocks and each is compressed with either; the difference of the compressed sizes for each byte of text says
which dictionary knows it better, and a logistic curve fitted on other labelled rows turns it into a
probability of label 1.

Fitting reads the whole texts of a bounded sample of labelled ids (2 * ``SAMPLE`` of each label, chosen by a hash of the id): half of them
are cut into blocks in the tasks, and of the different blocks of either label the ``BLOCKS`` with the least hashes, from
wherever in the texts, become its dictionary; of the other half the differences of at most 4 * ``SAMPLE`` different texts, chosen
likewise, fit the curve. So the driver gets bounded blocks and numbers, no text, however often an id repeats. Scoring reads whole texts.
Defined results: a null or empty text has difference 0 and gets the curve's value there; labels that are null
are not used; with labels of one kind only, or none, every text gets the share of label 1 (0.5 if there are
no labels); each input row gives one row, also where ids repeat with different texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.arrow import id_type, keyed_text, map_slices, slices

SAMPLE = 1500
BLOCK = 1024
#: Blocks that a dictionary is built from.
BLOCKS = 6000
DICTIONARY = 112_640
LEVEL = 3
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    bias: float


@lru_cache(maxsize=8)
def compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(text: str, good: bytes, bad: bytes) -> float:
    """Bytes that the bad dictionary takes more than the good one, for each byte of the text."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw or not good or not bad:
        return 0.0
    g, b = compressor(good), compressor(bad)
    parts = (raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK))
    return sum(len(b.compress(x)) - len(g.compress(x)) for x in parts) / len(raw)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def build_dictionary(blocks: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: the text itself serves
        return b"".join(blocks)[-DICTIONARY:]


def short_hash(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h (hash) and block of the blocks of each text."""
    for batch in batches:
        for text in batch.column("text"):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            parts = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
            for a in range(0, len(parts), 4096):
                own = parts[a : a + 4096]
                yield pa.record_batch([pa.array([short_hash(x) for x in own], pa.int64()), pa.array(own, pa.binary())], names=["h", "block"])


def measured(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """y, h (hash) and x (difference) of each text."""
    good, bad = shared.value
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column("text").to_pylist()
            hashes = [short_hash(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.record_batch([part.column("y"), pa.array(hashes, pa.int64()), pa.array([difference(t, good, bad) for t in texts], pa.float64())], names=["y", "h", "x"])


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve by Newton steps with a small penalty; x is scaled to unit spread."""
    spread = float(x.std()) or 1.0
    z = np.stack([x / spread, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (y - p)) - 1e-3 * beta
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / spread), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from labelled rows that are not held out."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(~held_out("_id"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = min(max(counts.get(1, 0) / total, 1e-6), 1 - 1e-6) if total else 0.5
        return Model(b"", b"", 0.0, float(np.log(share / (1 - share))))
    order = F.xxhash64(F.col("_id").cast("string"))
    ids = []
    for y in (0, 1):
        part = marks.where(F.col("y") == y).dropDuplicates(["_id"]).orderBy(order, "_id").limit(2 * sample)
        ids += part.select("_id", "y", F.pmod(F.xxhash64(F.lit("half"), F.col("_id").cast("string")), F.lit(2)).alias("half")).collect()
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame(ids, f"_id {id_type(labels, id_col)}, y int, half int"))  # 4 * sample ids at most
    texts = keyed_text(docs, id_col, text_col).join(chosen, F.col("doc_id") == F.col("_id"))
    dictionaries = []
    for y in (1, 0):
        blocks = texts.where(f"y = {y} and half = 0").select("text").mapInArrow(cut, "h long, block binary").dropDuplicates(["h"])
        dictionaries.append(build_dictionary([bytes(r["block"]) for r in blocks.orderBy("h").limit(BLOCKS).collect()]))
    shared = spark.sparkContext.broadcast(tuple(dictionaries))
    points = texts.where("half = 1").select("y", "text").mapInArrow(partial(measured, shared), "y int, h long, x double").dropDuplicates(["y", "h"])
    points = points.orderBy("h", "y").limit(4 * sample).collect()
    good, bad = dictionaries
    if len({r["y"] for r in points}) < 2:
        share = min(max(counts[1] / total, 1e-6), 1 - 1e-6)
        return Model(good, bad, 0.0, float(np.log(share / (1 - share))))
    x = np.array([r["x"] for r in points])
    y = np.array([r["y"] for r in points], float)
    share = np.where(y == 1, counts[1] / total / y.sum(), counts[0] / total / (1 - y).sum())
    return Model(good, bad, *fit_curve(x, y, share * len(y)))


def scored(shared, batch: pa.RecordBatch) -> pa.RecordBatch:
    m: Model = shared.value
    x = np.array([difference(t, m.good, m.bad) for t in batch.column("text").to_pylist()], float)
    p = 1 / (1 + np.exp(-np.clip(m.slope * x + m.bias, -30, 30)))
    return pa.record_batch([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 110 kB at most
    out = map_slices(keyed_text(docs, id_col, text_col), partial(scored, shared), f"doc_id {id_type(docs, id_col)}, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
