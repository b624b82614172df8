"""Aggregation, ranking, windows and sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate as accumulate_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.order import Order, rank_key, sort_columns
from weirflow.operators.rows import Expr, as_column
from weirflow.shared import materialised


def aggregate(df: DataFrame, keys: Sequence[str] | Mapping[str, Expr], aggregates: Mapping[str, Expr], having: Expr | None = None) -> DataFrame:
    """AGGREGATOR: keys, which may be expressions with names, stay in the output; ``having`` is over the output's columns."""
    group = [as_column(e).alias(k) for k, e in keys.items()] if isinstance(keys, Mapping) else [F.col(k) for k in keys]
    out = df.groupBy(*group).agg(*[as_column(e).alias(k) for k, e in aggregates.items()])
    return out if having is None else out.filter(as_column(having))


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Expr | Order], descending: bool = False) -> DataFrame:
    """The first row of each group by a declared order (dedup; a group-by without aggregates).

    An aggregate with map-side minima over whole rows: no sort of a group, so hot keys cost no more than others.
    """
    if not order:
        raise ValueError("keeping the first row needs a declared order")
    by = rank_key(df, order)
    pick = F.max_by if descending else F.min_by
    rest = [c for c in df.columns if c not in set(keys)]
    out = df.groupBy(*keys).agg(pick(F.struct(*rest), by).alias("_row"))
    return out.select(*[F.col(c) if c in set(keys) else F.col("_row").getField(c).alias(c) for c in df.columns])


def percentile(x: Expr, p: float) -> Column:
    """PERCENTILE with p as a share below 1 or in percent from 1 on, interpolated."""
    return F.percentile(as_column(x), p / 100 if p >= 1 else p)


def nearest_rank(x: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p / 100 if p >= 1 else p}) WITHIN GROUP (ORDER BY {x})")


def first_value(x: Expr, condition: Expr | None = None, order: Expr | None = None) -> Column:
    """FIRST as a deterministic aggregate: the least value, or that with the least order."""
    c = as_column(x) if condition is None else F.when(as_column(condition), as_column(x))
    return F.min(c) if order is None else F.min_by(c, as_column(order))


def last_value(x: Expr, condition: Expr | None = None, order: Expr | None = None) -> Column:
    c = as_column(x) if condition is None else F.when(as_column(condition), as_column(x))
    return F.max(c) if order is None else F.max_by(c, as_column(order))


def string_join(x: str, delimiter: str, order: str | None = None) -> Column:
    return F.expr(f"listagg({x}, '{delimiter}') WITHIN GROUP (ORDER BY {order or x})")


MISSING = "\x00missing"


def metered(events: DataFrame, keys: Sequence[str], quantity: str, time: str, start: object, end: object, adjustments: DataFrame | None = None, delta: str = "delta", distinct: str | None = None) -> DataFrame:
    """Usage in [start, end): sum with signed adjustments by the time of what they correct, greatest, last, and number of distinct
    values with one bucket for the missing."""
    inside = lambda d: d.filter((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))
    kinds = [F.sum(quantity).alias("used"), F.max(quantity).alias("greatest"), F.max_by(quantity, F.struct(time, quantity)).alias("last")]
    if distinct:
        kinds.append(F.count_distinct(F.coalesce(F.col(distinct).cast("string"), F.lit(MISSING))).alias("distinct_values"))
    out = inside(events).groupBy(*keys).agg(*kinds)
    if adjustments is None:
        return out
    sums = inside(adjustments).groupBy(*[F.col(k).alias(f"_a_{k}") for k in keys]).agg(F.sum(delta).alias("_delta"))
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"_a_{k}"))
    joined = out.join(sums, test, "full")
    shown = [F.coalesce(F.col(k), F.col(f"_a_{k}")).alias(k) for k in keys]
    used = (F.coalesce("used", F.lit(0)) + F.coalesce("_delta", F.lit(0))).alias("used")
    return joined.select(*shown, used, *[c for c in out.columns if c not in (*keys, "used")])


def finalised(fresh: DataFrame, frozen: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Aggregates of closed periods are served as they were frozen; only others are taken anew."""
    old = frozen.select(*keys, F.struct(*values).alias("_old"))
    out = fresh.join(old, list(keys), "full")
    return out.select(*keys, *[F.when(F.col("_old").isNotNull(), F.col("_old").getField(v)).otherwise(F.col(v)).alias(v) for v in values])


RANKS = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}


def top(df: DataFrame, n: int, order: Sequence[Expr | Order], keys: Sequence[str] = (), kind: str = "rank", position: str | None = None) -> DataFrame:
    """RANK: the first n of each group. rank keeps ties and may give more than n; row_number needs an order without ties.

    Spark limits groups before the shuffle (WindowGroupLimit); a global row_number is an ordered limit in each task first.
    """
    name = position or "_rank"
    w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    if not keys and kind == "row_number":
        df = df.orderBy(*sort_columns(order)).limit(n)
    out = df.withColumn(name, RANKS[kind]().over(w)).filter(F.col(name) <= n)
    return out if position else out.drop(name)


def qualify(df: DataFrame, windows: Mapping[str, Expr], condition: Expr) -> DataFrame:
    """QUALIFY: a filter over window functions, which are not in the output."""
    return df.withColumns({k: as_column(e) for k, e in windows.items()}).filter(as_column(condition)).drop(*windows)


def moving(df: DataFrame, keys: Sequence[str], order: Sequence[Expr | Order], rows: int, ports: Mapping[str, tuple[str, str]]) -> DataFrame:
    """MOVINGSUM, MOVINGAVG, ...: over the last ``rows`` rows. ports: name -> (function, column)."""
    w = Window.partitionBy(*keys).orderBy(*sort_columns(order)).rowsBetween(1 - rows, 0)
    return df.withColumns({name: getattr(F, f)(c).over(w) for name, (f, c) in ports.items()})


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[Expr | Order], ports: Mapping[str, tuple[str, str, int]]) -> DataFrame:
    """LAG, LEAD, NTILE, FIRST_VALUE, LAST_VALUE. ports: name -> (function, column, offset or number of tiles)."""
    w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made = {}
    for name, (f, c, n) in ports.items():
        made[name] = {"lag": lambda: F.lag(c, n).over(w), "lead": lambda: F.lead(c, n).over(w), "ntile": lambda: F.ntile(n).over(w), "first_value": lambda: F.first(c).over(whole), "last_value": lambda: F.last(c).over(whole)}[f]()  # noqa: B023
    return df.withColumns(made)


def sequence(df: DataFrame, name: str, order: Expr | Order, ties: Sequence[Expr | Order] = (), start: int = 1, step: int = 1, cycle: int | None = None, parts: int | None = None) -> DataFrame:
    """SEQUENCE: start, start + step, ... in the declared order, which ``order`` and ``ties`` make unique.

    Rows are dealt out by ranges of the whole order (``parts`` of them, by default as many as the session shuffles to), sorted and numbered within each, and moved on by
    the counts of the ranges before. The ranges come from a sample, so the input is read twice. A value of ``order`` that very many rows share is split by the ties. ``cycle`` begins anew after so many values.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = sort_columns([order, *ties])
    rows = materialised(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each range
    before = dict(zip([p for p, _ in counts], accumulate_counts([k for _, k in counts]), strict=True))
    moves = df.sparkSession.createDataFrame(list(before.items()), "_p long, _before long")
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    at = at if cycle is None else F.pmod(at, F.lit(cycle))
    return rows.join(F.broadcast(moves), part == F.col("_p")).select(*df.columns, (at * step + start).cast("long").alias(name))


def accumulate_counts(counts: Sequence[int]) -> list[int]:
    """How much stands before each."""
    return [0, *accumulate_(counts)][: len(counts)]


def survivors(df: DataFrame, keys: Sequence[str], columns: Mapping[str, tuple[str, Expr]]) -> DataFrame:
    """MERGE of records to one for each key. columns: name -> (rule, expression): of the values that are not null the one with the greatest (latest) or
    least (earliest) expression, or the longest or most frequent text by (longest, most_frequent), where the expression is the column itself; ties by the least value."""
    out = []
    for name, (rule, e) in columns.items():
        c, by = F.col(name), as_column(e)
        if rule in ("latest", "earliest"):
            pick = (F.max_by if rule == "latest" else F.min_by)(F.when(c.isNotNull(), c), F.when(c.isNotNull(), by))
        elif rule == "longest":
            pick = F.min_by(c, F.when(c.isNotNull(), F.struct(-F.length(c), c)))
        elif rule == "most_frequent":
            pick = F.mode(c, True)
        else:
            raise ValueError(f"no such rule: {rule}")
        out.append(pick.alias(name))
    return df.groupBy(*keys).agg(*out)


def mapping_variables(df: DataFrame, start: Mapping[str, object], ports: Mapping[str, tuple[str, Expr]], order: Expr | None = None) -> DataFrame:
    """One row with the variables as a session leaves them. ports: name -> (max, min, count or set, expression); start: what they begin with.

    count adds 1 for each insert and takes 1 for each delete (the expression is the row's action); set keeps the last value that is not null in the declared order.
    """
    out = []
    for name, (kind, e) in ports.items():
        v, first = as_column(e), F.lit(start[name])
        if kind in ("max", "min"):
            end = (F.greatest if kind == "max" else F.least)((F.max if kind == "max" else F.min)(v), first)
        elif kind == "count":
            end = first + F.coalesce(F.sum(F.when(v == "INSERT", 1).when(v == "DELETE", -1).otherwise(0)), F.lit(0))
        elif kind == "set":
            if order is None:
                raise ValueError("a variable that is set needs a declared order")
            end = F.coalesce(F.max_by(v, F.when(v.isNotNull(), as_column(order))), first)
        else:
            raise ValueError(f"no such kind: {kind}")
        out.append(end.alias(name))
    return df.agg(*out)


def accumulate(state: DataFrame, fresh: DataFrame, keys: Sequence[str], merges: Mapping[str, str]) -> DataFrame:
    """Incremental aggregation: earlier partial results with new ones. merges: column -> sum, min or max."""
    both = state.select(*keys, *merges).unionByName(fresh.select(*keys, *merges))
    return both.groupBy(*keys).agg(*[{"sum": F.sum, "min": F.min, "max": F.max}[kind](c).alias(c) for c, kind in merges.items()])


def health(runs: DataFrame, keys: Sequence[str], ok: Expr, duration: str, least_samples: int = 5, slow: float = 60_000.0, failing: float = 5.0) -> DataFrame:
    """Of each job: runs, failure rate in percent, mean, median and 95th percentile (nearest rank) of durations, and whether objectives are met; a percentile needs enough samples."""
    good = F.coalesce(as_column(ok), F.lit(False))
    out = runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), (F.count_if(~good) * 100.0 / F.count("*")).alias("failure_rate"), F.avg(duration).alias("mean_duration"), F.median(duration).alias("median_duration"), nearest_rank(duration, 0.95).alias("p95"))
    out = out.withColumn("p95", F.when(F.col("n_runs") >= least_samples, F.col("p95")))
    return out.withColumn("met", (F.col("failure_rate") <= failing) & F.coalesce(F.col("p95") <= slow, F.lit(True)))
