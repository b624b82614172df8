"""Operators that remember earlier rows of a stream: dynamic lookups, running variables, device twins and silent keys.

Each is a state machine over keyed state in RocksDB, whose changes Spark writes to the checkpoint with every micro-batch: a query that is started again goes on where
it was, whichever executors are lost. With a TTL Spark keeps looking at the clock, so such a query goes on until it is stopped, under any trigger. On a table the batch operators give the same rows. State is one value (or one entry for each attribute) a key, and goes
when it has not been written for ``ttl_ms``. The rows that a micro-batch brings for one key are put in the declared order in memory, so bound a micro-batch by the
source's options (maxFilesPerTrigger, maxOffsetsPerTrigger); keys that a dynamic lookup holds already stream through.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weirflow.operators import joins, rows
from weirflow.operators.order import Expr, Order, order, rank_key
from weirflow.operators.rows import as_column

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Streams that are started from now on keep their state in RocksDB, which these operators need."""
    spark.conf.set(PROVIDER, ROCKSDB)


def _plain(x: object) -> object:
    """A struct, which can come as a row or a dictionary, as a tuple that compares by its fields."""
    if isinstance(x, dict):
        return tuple(map(_plain, x.values()))
    return tuple(map(_plain, x)) if isinstance(x, tuple) else x


def _in_order(given: Iterator[Row]) -> list[Row]:
    return sorted(given, key=lambda r: _plain(r["_rank"]))


class _Lookup(StatefulProcessor):
    def __init__(self, out: T.StructType, held: T.StructType, flag: str, ttl_ms: int | None):
        self.out, self.schema, self.flag, self.ttl_ms = out, held, flag, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.schema, self.ttl_ms)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:  # noqa: N802, N803
        self.held.update(tuple(initialState[c] for c in self.schema.names))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held, new = (self.held.get() if self.held.exists() else None), 0
        if held is None:
            rows = _in_order(rows)
            held, new = tuple(rows[0][c] for c in self.schema.names), 1
            self.held.update(held)
        seen, made = dict(zip(self.schema.names, held, strict=True)), Row(*self.out.names)
        for r in rows:
            yield made(*(new if c == self.flag else seen[c] if c in seen else r[c] for c in self.out.names))
            new = 0

    def close(self) -> None:
        pass


def dynamic_lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], by: Sequence[Expr | Order], columns: Sequence[str], flag: str = "new_lookup_row", ttl_ms: int | None = None) -> DataFrame:
    """LOOKUP with a cache that rows add to, on a stream: each row with what is held for its keys, and whether it added that (``flag``).

    ``table`` is what is held at the start of the first run. Of the rows that a micro-batch brings for a key that is not held, the first by the declared order adds; of equal
    ranks the least row as a whole. On a table, the rows of the batch operator.
    """
    if not df.isStreaming:
        return joins.dynamic_lookup(df, table, keys, by, columns, flag)[0]
    if not by:
        raise ValueError("a dynamic lookup needs a declared order")
    keep_state_in_rocksdb(df.sparkSession)
    rest = [c for c in df.columns if c not in set(columns)]
    out = T.StructType([df.schema[c] for c in (*rest, *columns)] + [T.StructField(flag, T.IntegerType())])
    held = T.StructType([T.StructField(c, df.schema[c].dataType) for c in columns])
    ranked = df.withColumn("_rank", rank_key(df, [*by, *df.columns], plain=True))
    start = table.select(*[F.col(k).cast(df.schema[k].dataType).alias(k) for k in keys], *[F.col(c).cast(df.schema[c].dataType).alias(c) for c in columns])
    return ranked.groupBy(*keys).transformWithState(_Lookup(out, held, flag, ttl_ms), out, "Append", "None" if ttl_ms is None else "ProcessingTime", start.groupBy(*keys))


class _Running(StatefulProcessor):
    """State: for each port what it stands at, and whether there was a row yet."""

    def __init__(self, out: T.StructType, names: Sequence[str], ports: Mapping[str, str], state: T.StructType, ttl_ms: int | None):
        self.out, self.names, self.ports, self.schema, self.ttl_ms = out, list(names), dict(ports), state, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ports", self.schema, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now = dict(zip(self.ports, self.state.get(), strict=True)) if self.state.exists() else {p: 0 if kind in ("count", "number") else None for p, kind in self.ports.items()}
        made = Row(*self.out.names)
        with decimal.localcontext(prec=38):
            for r in _in_order(rows):
                before = dict(now)
                for p, kind in self.ports.items():
                    v, held = r[f"_v_{p}"], now[p]
                    if kind == "number":
                        now[p] = held + 1
                    elif kind == "previous":
                        now[p] = v
                    elif v is not None:
                        now[p] = held + 1 if kind == "count" else v if kind == "last" or held is None else held + v if kind == "sum" else min(held, v) if kind == "min" else max(held, v)
                yield made(*(r[c] for c in self.names), *(before[p] if kind == "previous" else now[p] for p, kind in self.ports.items()))
        self.state.update(tuple(now.values()))

    def close(self) -> None:
        pass


def running(df: DataFrame, by: Sequence[Expr | Order], keys: Sequence[str], ttl_ms: int | None = None, **ports: tuple[str, Expr]) -> DataFrame:
    """Stateful variables of a stream, as ``rows.running`` has them: previous, sum, count, min, max, last, number.

    Rows of a micro-batch come in the declared order, after those of earlier ones. On a table, the rows of the batch operator.
    """
    if not df.isStreaming:
        return rows.running(df, by, keys, **ports)
    if not by or not keys:
        raise ValueError("a running value of a stream needs a declared order and keys")
    keep_state_in_rocksdb(df.sparkSession)
    values = {f"_v_{p}": F.lit(1) if kind == "number" else as_column(e) for p, (kind, e) in ports.items()}
    given = df.withColumns(values)

    def kind_of(p: str, kind: str) -> T.DataType:
        t = given.schema[f"_v_{p}"].dataType
        if kind in ("count", "number"):
            return T.LongType()
        return _sum_type(t) if kind == "sum" else t

    if times := [p for p, (kind, _) in ports.items() if kind in ("min", "max") and isinstance(given.schema[f"_v_{p}"].dataType, T.TimestampType | T.TimestampNTZType)]:
        raise ValueError(f"give the times of {', '.join(times)} as unix_micros: state returns them in another zone")
    state = T.StructType([T.StructField(p, kind_of(p, kind)) for p, (kind, _) in ports.items()])
    out = T.StructType([*df.schema.fields, *state.fields])
    ranked = given.withColumn("_rank", rank_key(given, [*map(order, by), *df.columns], plain=True))
    machine = _Running(out, df.columns, {p: kind for p, (kind, _) in ports.items()}, state, ttl_ms)
    return ranked.groupBy(*keys).transformWithState(machine, out, "Append", "None" if ttl_ms is None else "ProcessingTime")


def _sum_type(t: T.DataType) -> T.DataType:
    if isinstance(t, T.DecimalType):
        return T.DecimalType(min(38, t.precision + 10), t.scale)
    return T.DoubleType() if isinstance(t, T.FloatType | T.DoubleType) else T.LongType()


class _Twin(StatefulProcessor):
    def __init__(self, out: T.StructType, value: T.StructType, ttl_ms: int | None):
        self.out, self.value, self.ttl_ms = out, value, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("attributes", T.StructType([T.StructField("attribute", T.StringType())]), self.value, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in _in_order(rows):
            name = (r["_attribute"],)
            held = self.held.getValue(name) if self.held.containsKey(name) else None
            rank = _plain(r["_rank"])
            if held is None or _plain(tuple(held[1:])) <= rank:
                self.held.updateValue(name, (r["_value"], *rank))
                yield Row(*self.out.names)(*key, r["_attribute"], r["_value"])

    def close(self) -> None:
        pass


def twin(df: DataFrame, keys: Sequence[str], attribute: Expr, value: Expr, by: Sequence[Expr | Order], ttl_ms: int | None = None) -> DataFrame:
    """Device twin: the latest reported value of each attribute of a key. On a stream every change that is not older than what is held, as it comes; on a table the last of each.

    A map state holds an entry for each attribute. Rows that are older than what is held change nothing. Columns: keys, ``attribute``, ``value``. Null attributes are left out.
    """
    if not by:
        raise ValueError("a twin needs a declared order")
    given = df.select(*keys, as_column(attribute).cast("string").alias("_attribute"), as_column(value).alias("_value"), rank_key(df, by, plain=True).alias("_rank")).where("_attribute is not null")
    if not df.isStreaming:
        out = given.groupBy(*keys, "_attribute").agg(F.max_by(F.struct("_value"), F.struct("_rank", "_value")).alias("v"))
        return out.select(*keys, F.col("_attribute").alias("attribute"), F.col("v._value").alias("value"))
    keep_state_in_rocksdb(df.sparkSession)
    state = T.StructType([T.StructField("value", given.schema["_value"].dataType), *given.schema["_rank"].dataType.fields])
    out = T.StructType([df.schema[k] for k in keys] + [T.StructField("attribute", T.StringType()), T.StructField("value", given.schema["_value"].dataType)])
    return given.groupBy(*keys).transformWithState(_Twin(out, state, ttl_ms), out, "Append", "None" if ttl_ms is None else "ProcessingTime")


class _Silence(StatefulProcessor):
    def __init__(self, out: T.StructType, after_ms: int):
        self.out, self.after_ms = out, after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros bigint, due bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.last.get() if self.last.exists() else None
        latest = held[0] if held else None
        for t in sorted(r["_micros"] for r in rows if r["_micros"] is not None):
            if latest is not None and t - latest > 1000 * self.after_ms:
                yield Row(*self.out.names)(*key, latest)  # the rows tell before the watermark does
            latest = t if latest is None else max(latest, t)
        if latest is not None and (held is None or latest > held[0]):
            if held:
                self.handle.deleteTimer(held[1])
            due = latest // 1000 + self.after_ms
            self.handle.registerTimer(due)
            self.last.update((latest, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.last.get()
        self.last.clear()
        yield Row(*self.out.names)(*key, held[0])

    def close(self) -> None:
        pass


def silent(df: DataFrame, keys: Sequence[str], time: str, after: str, delay: str = "30 seconds") -> DataFrame:
    """Keys of which nothing came for so long after their last row, once the watermark is past that: keys and ``last_seen``.

    A timer for each key, moved on by every row; a key that comes again later can fall silent again. On a table: every gap longer than ``after`` and the end of each key that lies so far before the latest row of all.
    """
    import pandas as pd

    after_ms = int(pd.Timedelta(after).total_seconds() * 1000)
    micros = _micros(df, time)
    if not df.isStreaming:
        from pyspark.sql import Window

        w = Window.partitionBy(*keys).orderBy("_m")
        rows_ = df.select(*keys, F.col(time).alias("_t"), micros.alias("_m")).where("_m is not null")
        end = rows_.agg(F.max("_m").alias("_end"))
        gap = rows_.withColumn("_next", F.lead("_m").over(w)).crossJoin(F.broadcast(end))  # one row
        return gap.where(F.coalesce("_next", "_end") - F.col("_m") > after_ms * 1000).select(*keys, F.col("_t").alias("last_seen"))
    keep_state_in_rocksdb(df.sparkSession)
    given = df.withWatermark(time, delay).select(*keys, time, micros.alias("_micros"))
    out = T.StructType([df.schema[k] for k in keys] + [T.StructField("_micros", T.LongType())])
    made = given.groupBy(*keys).transformWithState(_Silence(out, after_ms), out, "Append", "EventTime")
    return made.select(*keys, F.timestamp_micros("_micros").cast(df.schema[time].dataType).alias("last_seen"))


def _micros(df: DataFrame, time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))
