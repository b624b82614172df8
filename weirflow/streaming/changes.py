"""Change data: the latest state by key, and its upkeep from a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weirflow.operators.loads import merge, recover, save


def latest(changes: DataFrame, keys: Sequence[str], sequence: Sequence[str], operation: str | None = None, deletes: Sequence[str] = ("d", "D", "delete", "DELETE")) -> DataFrame:
    """The last change of each key by the sequence columns; deleted keys are left out if ``operation`` names the kind of change.

    max_by with map-side maxima: no sort of a key's changes.
    """
    if not keys:
        raise ValueError("changes can only be applied by keys")
    rest = [c for c in changes.columns if c not in set(keys)]
    out = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*sequence)).alias("_row"))
    out = out.select(*[F.col(c) if c in set(keys) else F.col("_row").getField(c).alias(c) for c in changes.columns])
    return out if operation is None else out.filter(~F.col(operation).isin(*deletes))


def apply_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str], sequence: Sequence[str], operation: str | None = None, deletes: Sequence[str] = ("d", "D", "delete", "DELETE"), tombstone: str | None = None) -> DataFrame:
    """The target after the changes (type 1). A change older than the row it meets is not applied, so a batch can come twice.

    With ``tombstone`` the target has a boolean column of that name: a delete keeps its row and sequence under true, so that an
    older change that comes later finds it. Without it a deleted key is forgotten, and such a change inserts it again.
    """
    last = latest(changes, keys, sequence)
    gone = F.col(f"s.{operation}").isin(*deletes) if operation else F.lit(False)
    newer = F.struct(*[F.col(f"s.{c}") for c in sequence]) >= F.struct(*[F.col(f"t.{c}") for c in sequence])
    if tombstone:
        marked = F.col(operation).isin(*deletes) if operation else F.lit(False)
        return merge(target, last.withColumn(tombstone, F.coalesce(marked, F.lit(False))), keys, update=newer)
    return merge(target, last, keys, delete=gone & newer, update=newer, insert=~gone)


def keep_target(changes: DataFrame, path: str, checkpoint: str, keys: Sequence[str], sequence: Sequence[str], operation: str | None = None, tombstone: str = "_deleted", **trigger: object) -> StreamingQuery:
    """A query that keeps the table at ``path`` at the state of a stream of changes, deleted rows under ``tombstone``; ``current`` reads the others.

    A micro-batch rewrites the table, as plain files cannot be changed in place.
    """

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        recover(spark, path)
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        target = spark.read.parquet(path) if there else spark.createDataFrame([], batch.schema).withColumn(tombstone, F.lit(False))
        save(apply_changes(target, batch, keys, sequence, operation, tombstone=tombstone), path)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def current(table: DataFrame, tombstone: str = "_deleted") -> DataFrame:
    """The rows of a kept table that are not deleted."""
    return table.filter(~F.col(tombstone)).drop(tombstone)
