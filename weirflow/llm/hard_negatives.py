"""Hard negatives by inner product, found through a pivot table.

Components become whole numbers, floor(scale * x), so scores are exact. With M the longest row's length, a row x gets one component more,
sqrt(M^2 - |x|^2), and an anchor q gets a zero there: then |q - x|^2 = |q|^2 + M^2 - 2 q.x, and a score is a Euclidean distance. Every row
stores its distances to ``PIVOTS`` pivots, rows of a bounded sample that lie far apart. By the triangle inequality an anchor's and a row's distances to a pivot
bracket their own distance and so their score: |a - b| <= d <= a + b. First a run of neighbouring rows is bracketed as a whole, from the least and greatest distance it
has to each pivot, then its rows one by one; what can still be among the first is checked exactly. The pivots only decide what is skipped, never a result.

Anchors are taken in blocks of about ``BLOCK``, which are broadcast; the table of rows is never shuffled after it is made, and each task hands on its own first rows of an anchor only. So neither a
frequent label nor a vector that many rows share is gathered anywhere. A block takes two passes over the table: positives, then the negatives of each.

Defined results: rows without an id, a label or a vector, and those with a null or non-finite component, take no part; a row repeated with its label and vector counts once; different rows
of one id are different rows, and only the row itself is not its own positive. Shorter vectors are as if zeros followed. Equal scores go by the lesser id. An anchor without positives, or a
positive without negatives in its window, gives no row; an empty table gives none. Lengths whose square is 2^56 or more, beyond whole scores, are refused with an error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.arrow import shared_dir

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score in percent of the positive's.
LEAST, MOST = 30, 90
PIVOTS = 16
SAMPLE = 1024
BLOCK = 4096
#: Rows that are bracketed together, and anchors that are looked at together.
RUN = 512
TOGETHER = 1024
#: Pairs of a run that survive, as a share, from which on all of its products are taken at once.
DENSE = 0.02
NONE = np.iinfo(np.int64).min


def whole(df: DataFrame, id_col: str, vec_col: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """``id``, ``label``, ``vec`` (whole numbers as doubles) and ``anchor``, each different row once."""
    odd = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & label.isNotNull()).where(~odd)
    vec = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vec.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    return rows.groupBy("id", "label", "vec").agg(F.max("anchor").alias("anchor"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of ``width``, zeros behind shorter ones."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(column.offsets.to_numpy())
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = flat
    return out


def far_apart(sample: np.ndarray, square: float, n: int) -> np.ndarray:
    """Of augmented rows those that each lie farthest from the ones before."""
    rows = augmented(sample, square)
    if not len(rows):
        return rows
    chosen = [int(np.argmax(((rows - rows.mean(axis=0)) ** 2).sum(axis=1)))]
    near = np.full(len(rows), np.inf)
    while True:
        near = np.minimum(near, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        k = int(np.argmax(near))
        if len(chosen) >= n or near[k] <= 0:
            return rows[chosen]
        chosen.append(k)


def augmented(x: np.ndarray, square: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each row to each pivot."""
    d = (rows * rows).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(d, 0))


@dataclass
class Table:
    """The rows with their stored distances, and what brackets need to know."""

    rows: DataFrame
    pivots: np.ndarray
    width: int
    square: float


def pivot_table(rows: DataFrame, pivots: int = PIVOTS) -> Table:
    """Rows with their distances to the pivots (``far``), near ones side by side in each partition."""
    rows = rows.checkpoint()
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    width, longest = rows.agg(F.max(F.size("vec")), F.max(square)).first()
    if longest is not None and longest >= 2.0**56:
        raise ValueError("the vectors are too long for whole scores")
    width, longest = width or 0, longest or 0.0
    sample = [r["vec"] for r in rows.orderBy(F.xxhash64("vec")).limit(SAMPLE).select("vec").collect()]
    points = far_apart(matrix(pa.array(sample, pa.list_(pa.float64())), width), longest, pivots)
    kind = "float" if longest < 2.0**48 else "double"  # such whole numbers are exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = distances(augmented(matrix(b.column("vec"), width), longest), points)
            nearest = far.argmin(axis=1)
            lists = pa.ListArray.from_arrays(np.arange(len(far) + 1, dtype=np.int32) * far.shape[1], pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(nearest.astype(np.int32)), pa.array(far[np.arange(len(far)), nearest])], ["id", "label", "vec", "anchor", "far", "cell", "near"])

    rows = rows.withColumn("vec", F.col("vec").cast(f"array<{kind}>"))
    made = rows.withColumn("vec", F.col("vec").cast("array<double>")).mapInArrow(run, "id long, label long, vec array<double>, anchor boolean, far array<double>, cell int, near double")
    made = made.sortWithinPartitions("cell", "near").select("id", "label", F.col("vec").cast(f"array<{kind}>").alias("vec"), "anchor", "far").checkpoint()
    return Table(made, points, width, longest)


class Best:
    """The first ``k`` of each slot by score, then id: at most ``k`` a slot are held."""

    def __init__(self, slots: int, k: int):
        self.k, self.slot, self.score, self.id = k, *(np.zeros(0, np.int64) for _ in range(3))
        #: What a score must reach to be among them.
        self.bound = np.full(slots, NONE)

    def add(self, slot: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, row = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, row)))
        order = np.lexsort((row, -score, slot))
        slot, score, row = slot[order], score[order], row[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
        last = place == self.k - 1
        self.bound[slot[last]] = score[last]
        keep = place < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], row[keep]


@dataclass
class Anchors:
    """A block of anchors: their rows, distances to the pivots and, in the second pass, the scores of their positives (one row an anchor, NONE behind the last)."""

    id: np.ndarray
    label: np.ndarray
    vec: np.ndarray
    square: np.ndarray
    far: np.ndarray
    positives: np.ndarray | None = None

    def part(self, a: slice) -> Anchors:
        return Anchors(*(None if x is None else x[a] for x in (self.id, self.label, self.vec, self.square, self.far, self.positives)))


def exact(q: np.ndarray, x: np.ndarray, square: float) -> np.ndarray:
    """Products of whole numbers: in doubles where all sums are exact, else in longs."""
    return np.rint(q @ x.T).astype(np.int64) if square < 2.0**52 else q.astype(np.int64) @ x.astype(np.int64).T


def scan(batch: pa.RecordBatch, anchors: Anchors, best: Best, table: Table, first: int, window: tuple[int, int]) -> int:
    """Adds the rows of a batch that can be among the first of an anchor (of a positive, in the second pass); how many pairs were checked exactly."""
    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
    vec = matrix(batch.column("vec"), table.width).astype(np.float64)
    far = matrix(batch.column("far"), len(table.pivots))
    squares = (vec * vec).sum(axis=1)
    total = anchors.square + table.square
    slack = 1e-9 * (total + table.square) + 1e-6  # far above what rounding can do
    deep = 1 if anchors.positives is None else anchors.positives.shape[1]
    slots = (first + np.arange(len(anchors.id)))[:, None] * deep + np.arange(deep)
    checked = 0
    if anchors.positives is not None:
        p = anchors.positives
        given = p != NONE
        lo, hi = np.where(given, window[0] * np.where(given, p, 0), np.iinfo(np.int64).max), np.where(given, window[1] * np.where(given, p, 0), NONE)
        least, most = lo.min(axis=1) / 100, hi.max(axis=1) / 100
    for start in range(0, len(ids), RUN):
        rows = slice(start, min(start + RUN, len(ids)))
        own = labels[rows]
        bound = best.bound[slots].min(axis=1).astype(np.float64)  # of all that an anchor asks for
        floor, ceiling = (bound, np.full(len(bound), np.inf)) if anchors.positives is None else (np.maximum(bound, least), most)
        low, high = far[rows].min(axis=0), far[rows].max(axis=0)
        closest = np.maximum(np.maximum(anchors.far - high, low - anchors.far), 0).max(axis=1)
        farthest = (anchors.far + high).min(axis=1)
        alive = ((total - closest**2) / 2 + slack >= floor) & ((total - farthest**2) / 2 - slack <= ceiling)
        alive &= np.isin(anchors.label, own) if anchors.positives is None else (own.min() != own.max()) | (anchors.label != own[0])
        a = np.flatnonzero(alive)
        if not len(a):
            continue
        same = anchors.label[a][:, None] == own
        closest, farthest = np.zeros(same.shape), np.full(same.shape, np.inf)
        for k in range(far.shape[1]):
            x, y = anchors.far[a, k][:, None], far[rows, k]
            np.maximum(closest, np.abs(x - y), out=closest)
            np.minimum(farthest, x + y, out=farthest)
        can = ((total[a, None] - closest**2) / 2 + slack[a, None] >= floor[a, None]) & ((total[a, None] - farthest**2) / 2 - slack[a, None] <= ceiling[a, None]) & (same if anchors.positives is None else ~same)
        i, j = np.nonzero(can)
        if not len(i):
            continue
        checked += len(i)
        if len(i) >= DENSE * can.size:
            score = exact(anchors.vec[a], vec[rows], table.square)[i, j]
        else:
            kind = np.float64 if table.square < 2.0**52 else np.int64
            score = np.rint(np.einsum("ij,ij->i", anchors.vec[a[i]].astype(kind), vec[rows][j].astype(kind))).astype(np.int64)
        i, j = a[i], j + start
        if anchors.positives is None:
            itself = (ids[j] == anchors.id[i]) & (score == anchors.square[i]) & (squares[j] == anchors.square[i])
            good = ~itself & (score >= best.bound[first + i])
            best.add(first + i[good], score[good], ids[j[good]])
        else:
            for n in range(deep):
                good = (100 * score >= lo[i, n]) & (100 * score <= hi[i, n]) & (score >= best.bound[slots[i, n]])
                best.add(slots[i[good], n], score[good], ids[j[good]])
    return checked


def first_of_each(table: Table, anchors: Anchors, k: int, window: tuple[int, int]) -> DataFrame:
    """``slot``, ``rank``, ``id`` and ``score`` of the first k rows for each anchor, or each of its positives."""
    sent = table.rows.sparkSession.sparkContext.broadcast(anchors)
    about = Table(None, table.pivots, table.width, table.square)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        deep = 1 if block.positives is None else block.positives.shape[1]
        best = Best(len(block.id) * deep, k)
        for b in batches:
            for at in range(0, len(block.id), TOGETHER):
                scan(b, block.part(slice(at, at + TOGETHER)), best, about, at, window)
        yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.score), pa.array(best.id)], ["slot", "score", "id"])

    found = table.rows.select("id", "label", "vec", "far").mapInArrow(run, "slot long, score long, id long")
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``: for each of an anchor's first ``positives`` rows of its own label the
    first ``negatives`` rows of other labels whose score is from ``least`` to ``most`` percent of the positive's. Rows for which ``anchor`` is true are the anchors."""
    spark = df.sparkSession
    shared_dir(spark)
    table = pivot_table(whole(df, id_col, vec_col, F.col("label") if label is None else label, anchor, scale), pivots)
    asked = table.rows.where("anchor").select("id", "label", "vec", F.xxhash64("id", "label", "vec").alias("at")).checkpoint()
    blocks = max(1, -(-asked.count() // block))
    out = None
    for b in range(blocks):
        share = sorted(asked.where(F.pmod("at", F.lit(blocks)) == b).collect(), key=lambda r: (r["id"], r["label"], r["vec"]))  # about a block
        vec = matrix(pa.array([r["vec"] for r in share], pa.list_(pa.float64())), table.width)
        anchors = Anchors(np.array([r["id"] for r in share], np.int64), np.array([r["label"] for r in share], np.int64), vec, np.rint((vec * vec).sum(axis=1)), distances(np.c_[vec, np.zeros(len(vec))], table.pivots))
        found = first_of_each(table, anchors, positives, (least, most)).collect()  # a few for each anchor of the block
        anchors.positives = np.full((len(share), positives), NONE)
        names = {}
        for r in found:
            anchors.positives[r["slot"], r["rank"] - 1] = r["score"]
            names[r["slot"], r["rank"] - 1] = r["id"]
        schema = "slot long, anchor_id long, positive_id long, positive_score long"
        named = spark.createDataFrame([(s * positives + k, int(anchors.id[s]), p, int(anchors.positives[s, k])) for (s, k), p in names.items()], schema)
        hard = first_of_each(table, anchors, negatives, (least, most)).join(named, "slot")
        made = hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).checkpoint()
        out = made if out is None else out.unionByName(made)
    return out


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's anchors (ids divisible by 100) and labels (the next one where the id is divisible by 7)."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings, F.col("vec_id") % 100 == 0, label=label)


def oracle() -> str:
    return f"""
    WITH base AS (
        SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS vec
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    pairs AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.vec, b.vec) AS BIGINT) AS score
        FROM base a JOIN base b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positives AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN pairs USING (anchor_id)
    WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
    QUALIFY row_number() OVER w <= {NEGATIVES}"""
