"""Running values over one order of the whole table, without a task that sees all of it.

A window without keys, or over a key that a third of the rows share, is one task. Here the rows are dealt out by ranges of (keys, order), so that neither is: each range is
folded by itself, what it ends with (its carry) is folded over the ranges before, and is added to the rows of the range in the same pass that folds
them. Only a key that goes on from one range into the next has carries: at most two keys a range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.operators.order import Expr, Order, rank_key, sort_columns
from weirflow.shared import materialised

KINDS = ("previous", "sum", "count", "min", "max", "last", "number")


def scan(df: DataFrame, order: Sequence[Expr | Order], keys: Sequence[str] = (), ranges: int | None = None, **ports: tuple[str, Expr]) -> DataFrame:
    """Running values in a declared order. ports: name=(kind, expression).

    previous: the value of the row before; sum, count, min, max: of all values so far, nulls left out; last: the latest value that is not null; number: 1, 2, ... (the
    expression is ignored). ``ranges``: how many, by default as many as the session shuffles to. Equal ranks are put in order by a hash of the row; equal rows may
    take each other's places. Null keys are one key. The rows are written once (their ranges come from a sample, so the input is read twice) and shuffled twice: to
    ranges, and to the windows in them. Sums of doubles are added in another order than by one task.
    """
    from weirflow.operators.rows import as_column

    if not order:
        raise ValueError("a running value needs a declared order")
    if bad := [kind for kind, _ in ports.values() if kind not in KINDS]:
        raise ValueError(f"no such kind: {', '.join(bad)}; there are {', '.join(KINDS)}")
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]
    full = [*order, Order("_tie")]
    rows = df.withColumns({"_tie": F.xxhash64(*hashed), **{f"_v_{p}": F.lit(1) if kind == "number" else as_column(e) for p, (kind, e) in ports.items()}})
    places = [F.col(k).asc_nulls_first() for k in keys] + sort_columns(full)
    rows = materialised(rows.repartitionByRange(n, *places).withColumn("_range", F.spark_partition_id()))

    inside = Window.partitionBy("_range", *keys).orderBy(*sort_columns(full))
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    v = lambda p: F.col(f"_v_{p}")
    fold = {"sum": F.sum, "count": F.count, "number": F.count, "min": F.min, "max": F.max}
    local = {}
    for p, (kind, _) in ports.items():
        local[f"_l_{p}"] = F.lag(F.struct(v(p).alias("v"))).over(inside) if kind == "previous" else F.last(v(p), ignorenulls=True).over(so_far) if kind == "last" else fold[kind](v(p)).over(so_far)
    carried = carries(rows, full, keys, ports)
    renamed = carried.withColumnsRenamed({c: f"_c{c}" for c in ("_range", *keys)})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_c{c}")) for c in ("_range", *keys)])
    both = rows.withColumns(local).join(F.broadcast(renamed), same, "left")  # two rows a range at most
    out = []
    for p, (kind, _) in ports.items():
        mine, before = F.col(f"_l_{p}"), F.col(f"_b_{p}")
        if kind == "previous":
            made = F.coalesce(mine, before).getField("v")
        elif kind == "last":
            made = F.coalesce(mine, before)
        elif kind in ("min", "max"):
            made = (F.least if kind == "min" else F.greatest)(mine, before)
        else:  # null only where there was no value yet
            made = F.coalesce(mine + before, mine, before)
        out.append(made.cast(rows.select(_type_of(kind, v(p)).alias("t")).schema["t"].dataType).alias(p))
    return both.select(*df.columns, *out)


def _type_of(kind: str, c: Column) -> Column:
    return F.sum(c) if kind == "sum" else F.count(c) if kind in ("count", "number") else c


def carries(rows: DataFrame, order: Sequence[Expr | Order], keys: Sequence[str], ports: dict[str, tuple[str, Expr]]) -> DataFrame:
    """Of each range and key that goes on into it: what the ranges before leave, in columns ``_b_<port>``."""
    if keys:
        key = F.struct(*keys)
        ends = rows.groupBy("_range").agg(F.min(key).alias("_a"), F.max(key).alias("_b"))
        edge = ends.select(F.explode(F.array("_a", "_b")).alias("_edge")).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_edge").getField(k)) for k in keys])
        rows = rows.join(F.broadcast(edge), same, "left_semi")  # two keys a range at most
    by = rank_key(rows, order)
    v = lambda p: F.col(f"_v_{p}")
    aggregates = {"sum": F.sum, "count": F.count, "number": F.count, "min": F.min, "max": F.max}
    made = []
    for p, (kind, _) in ports.items():
        c = F.max_by(F.struct(v(p).alias("v")), by) if kind == "previous" else F.max_by(v(p), F.when(v(p).isNotNull(), by)) if kind == "last" else aggregates[kind](v(p))
        made.append(c.alias(f"_e_{p}"))
    ended = rows.groupBy("_range", *keys).agg(*made)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    outer = {"sum": F.sum, "count": F.sum, "number": F.sum, "min": F.min, "max": F.max}
    folded = []
    for p, (kind, _) in ports.items():
        e = F.col(f"_e_{p}")
        c = F.last(e).over(before) if kind == "previous" else F.last(e, ignorenulls=True).over(before) if kind == "last" else outer[kind](e).over(before)
        folded.append(c.alias(f"_b_{p}"))
    return ended.select("_range", *keys, *folded)
