"""What became of the rows of a load or a stream, counted while they pass: nothing is read twice to count it.

``observe`` takes the counts in the tasks that move the rows. Late rows of a stream, which Spark drops without a trace, go to a side of the output.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from weirflow.operators.loads import _files
from weirflow.operators.order import Expr
from weirflow.operators.rows import as_column


def counted_load(df: DataFrame, path: str, tests: Mapping[str, Expr], mode: str = "append", format: str = "parquet") -> dict[str, int]:
    """Writes the rows that pass all tests, in their order, and returns how many were read, failed each test (as the first that fails; a null fails) and were written."""
    seen, put = Observation(), Observation()
    first = F.lit(None).cast("string")
    for name, test in reversed(tests.items()):
        first = F.when(~F.coalesce(as_column(test), F.lit(False)), name).otherwise(first)
    rows = df.withColumn("_failed", first)
    rows = rows.observe(seen, F.count(F.lit(1)).alias("read"), *[F.count_if(F.col("_failed") == name).alias(name) for name in tests])
    good = rows.where("_failed is null").drop("_failed").observe(put, F.count(F.lit(1)).alias("written"))
    good.write.mode(mode).format(format).save(path)
    return {**seen.get, **put.get}


def keep_with_late(stream: DataFrame, time: str, delay: str, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Writes every row of a stream to ``path/rows``, those that are late or without a time marked, and the counts of each micro-batch to ``path/counts``; ``on_time``, ``late`` and ``counts`` read them.

    A row is late if it is more than ``delay`` behind the latest time of the micro-batches before its own, as a watermark has it. A micro-batch is one pass and one folder, so one that comes again
    replaces what it wrote before.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [c["latest"] for c in (counts(spark, path).where(F.col("batch") < number).agg(F.max("latest").alias("latest")).collect() if _there(spark, f"{path}/counts") else []) if c["latest"]]
        kind = batch.schema[time].dataType
        mark = F.lit(before[0]).cast(kind) - F.expr(f"interval {delay}") if before else F.lit(None).cast(kind)
        side = F.when(F.col(time).isNull(), "untimed").when(F.coalesce(F.col(time) < mark, F.lit(False)), "late").otherwise("on time")
        seen = Observation()
        rows = batch.withColumn("side", side)
        is_ = lambda s: F.count_if(F.col("side") == s)
        rows = rows.observe(seen, F.count(F.lit(1)).alias("read"), is_("on time").alias("on_time"), is_("late").alias("late"), is_("untimed").alias("untimed"), F.max(time).alias("latest"))
        rows.write.mode("overwrite").partitionBy("side").parquet(f"{path}/rows/batch={number}")
        got = seen.get
        schema = f"read long, on_time long, late long, untimed long, latest {kind.simpleString()}"
        spark.createDataFrame([tuple(got[c] for c in ("read", "on_time", "late", "untimed", "latest"))], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def _there(spark: SparkSession, path: str) -> bool:
    place, fs = _files(spark, path)
    return bool(fs.globStatus(place(f"{path}/batch=*")))


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")


def on_time(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path).where("side = 'on time'").drop("side", "batch")


def late(spark: SparkSession, path: str) -> DataFrame:
    """Late rows and those without a time, with their ``side`` and ``batch``."""
    return _rows(spark, path).where("side <> 'on time'")


def counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/counts").parquet(f"{path}/counts")


class Progress(StreamingQueryListener):
    """The last ``keep`` progress reports of all queries as rows: what came in, what state operators dropped as late and where the watermark stood."""

    SCHEMA = "name string, batch long, rows_in long, dropped_late long, watermark string, state_rows long"

    def __init__(self, keep: int = 1000):
        self.reports: deque[tuple] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        states = p.stateOperators or []
        self.reports.append((p.name, p.batchId, p.numInputRows, sum(s.numRowsDroppedByWatermark for s in states), (p.eventTime or {}).get("watermark"), sum(s.numRowsTotal for s in states)))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.reports), self.SCHEMA)
