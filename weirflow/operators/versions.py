"""A table in hash buckets with versions: a change rewrites the buckets it touches and becomes visible in one step.

``path/data/<id>/_bucket=<n>/`` holds Parquet files that are never changed; ``path/versions/<number>.json`` names, for one version, the schema, the keys, the number of buckets and the folder of each
bucket. A writer puts new folders beside the old ones and then adds the next manifest by a rename, so a writer that dies at any point leaves the last version as it is, and
readers see a version as a whole. Two writers of one version: the second is refused (where the store's rename refuses to replace, as HDFS does; keep to one writer elsewhere) and its data stay unseen.
A manifest also remembers the ``token`` of each source's last change: a change that comes again (a micro-batch after a restart) is left out. Manifests have an entry for each bucket, whatever the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weirflow.operators.loads import _files, merge
from weirflow.streaming.changes import apply_changes

BUCKETS = 64
DIGITS = 12


class Conflict(Exception):
    """Another writer has made the version that this one was about to make."""


@dataclass(frozen=True)
class Version:
    """``folders``: of each bucket that has rows, the folder under ``data`` that holds it; ``tokens``: of each source the last change that is in."""

    number: int
    keys: tuple[str, ...]
    buckets: int
    schema: str
    folders: dict[str, str]
    tokens: dict[str, int]

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions there are."""
    place, fs = _files(spark, path)
    found = fs.globStatus(place(f"{path}/versions/*.json"))
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found or ())


def describe(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version's manifest, by default the last one's."""
    there = versions(spark, path)
    if not there:
        raise FileNotFoundError(f"{path} has no version")
    if number is not None and number not in there:
        raise ValueError(f"{path} has no version {number}")
    text = spark.read.text(f"{path}/versions/{number or there[-1]:0{DIGITS}d}.json", wholetext=True).first()[0]
    made = json.loads(text)
    return Version(**(made | {"keys": tuple(made["keys"])}))


def _commit(spark: SparkSession, path: str, new: Version) -> None:
    place, fs = _files(spark, path)
    draft, final = place(f"{path}/drafts/{uuid.uuid4().hex}"), place(f"{path}/versions/{new.number:0{DIGITS}d}.json")
    fs.mkdirs(place(f"{path}/versions"))
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(asdict(new)).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"version {new.number} of {path} is there already")


def _bucket(schema: T.StructType, keys: Sequence[str], buckets: int) -> Column:
    """By the keys as the target has them; a null hashes like any value."""
    return F.pmod(F.xxhash64(*[F.col(k).cast(schema[k].dataType) for k in keys]), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, schema: T.StructType, keys: Sequence[str], buckets: int) -> dict[str, str]:
    """The folders of the buckets that got rows."""
    name = uuid.uuid4().hex
    rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).withColumn("_bucket", _bucket(schema, keys, buckets))
    rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/data/{name}")
    place, fs = _files(df.sparkSession, path)
    return {f.getPath().getName().removeprefix("_bucket="): name for f in fs.globStatus(place(f"{path}/data/{name}/_bucket=*")) or ()}


def create(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> Version:
    """The first version, from the rows of ``df``."""
    new = Version(1, tuple(keys), buckets, df.schema.json(), _write(df, path, df.schema, keys, buckets), {})
    _commit(df.sparkSession, path, new)
    return new


def read(spark: SparkSession, path: str, number: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
    """The rows of a version (by default the last), or of some of its buckets."""
    v = describe(spark, path, number)
    return _rows(spark, path, v, only)


def _rows(spark: SparkSession, path: str, v: Version, only: Sequence[int] | None = None) -> DataFrame:
    wanted = v.folders if only is None else {b: f for b, f in v.folders.items() if int(b) in set(only)}
    if not wanted:
        return spark.createDataFrame([], v.struct)
    return spark.read.schema(v.struct).parquet(*[f"{path}/data/{f}/_bucket={b}" for b, f in sorted(wanted.items())])


def change(path: str, source: DataFrame, made: Callable[[DataFrame, DataFrame], DataFrame], source_name: str = "", token: int | None = None) -> Version:
    """The next version: ``made`` gives the new content of the buckets that the source's keys touch, from their present rows and the source.

    With a ``token``, a change whose token is not above the last one of ``source_name`` changes nothing. A source without rows makes no version.
    """
    spark = source.sparkSession
    now = describe(spark, path)
    if token is not None and token <= now.tokens.get(source_name, -1):
        return now
    touched = sorted(r[0] for r in source.select(_bucket(now.struct, now.keys, now.buckets).alias("b")).distinct().collect())  # at most ``buckets``
    tokens = now.tokens if token is None else now.tokens | {source_name: token}
    if not touched and token is None:
        return now
    folders = dict(now.folders)
    if touched:
        fresh = _write(made(_rows(spark, path, now, touched), source), path, now.struct, now.keys, now.buckets)
        for b in map(str, touched):
            folders.pop(b, None)
        folders |= fresh
    new = replace(now, number=now.number + 1, folders=folders, tokens=tokens)
    _commit(spark, path, new)
    return new


def merge_into(path: str, source: DataFrame, source_name: str = "", token: int | None = None, **how: object) -> Version:
    """MERGE into the table by its keys; ``how`` as for ``loads.merge``. Buckets without a source row are neither read nor written."""
    keys = describe(source.sparkSession, path).keys
    return change(path, source, lambda old, new: merge(old, new, keys, **how), source_name, token)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all but the last ``keep`` versions and the data that none of those names; how many folders went. Not while a writer is at work."""
    there = versions(spark, path)
    kept = [describe(spark, path, n) for n in there[-keep:]]
    used = {f for v in kept for f in v.folders.values()}
    place, fs = _files(spark, path)
    for n in there[:-keep]:
        fs.delete(place(f"{path}/versions/{n:0{DIGITS}d}.json"), False)
    gone = [f.getPath() for f in fs.globStatus(place(f"{path}/data/*")) or () if f.getPath().getName() not in used]
    for p in gone:
        fs.delete(p, True)
    return len(gone)


def keep_versioned(changes: DataFrame, path: str, checkpoint: str, keys: Sequence[str], sequence: Sequence[str], operation: str | None = None, tombstone: str = "_deleted", buckets: int = BUCKETS, **trigger: object) -> StreamingQuery:
    """A query that keeps the table at the state of a stream of changes, deleted rows under ``tombstone``: a micro-batch rewrites the buckets it touches, and one that comes again changes nothing."""

    def one(batch: DataFrame, number: int) -> None:
        if not versions(batch.sparkSession, path):
            create(batch.limit(0).withColumn(tombstone, F.lit(False)), path, keys, buckets)
        change(path, batch, lambda old, new: apply_changes(old, new, keys, sequence, operation, tombstone=tombstone), checkpoint, number)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
