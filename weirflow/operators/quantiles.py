"""Exact percentiles and medians of groups of any size.

Spark's exact percentile holds all distinct values of a group in one task. Here a group with more than ``LARGE`` rows is never gathered: each row that is asked for by its rank is closed in on. A pass
counts the rows of its range in ``BUCKETS`` parts of equal length and as many of equal ratio, in each task first, keeps the part that holds the rank and takes that part's least and greatest value for the next
pass, until both are the same. Each pass splits off a value at least; evenly spread values fall to a thousandth, and values of any magnitudes to within a few powers of two, so a few passes do. Smaller groups go to
Spark's own function.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.order import Expr
from weirflow.operators.rows import as_column
from weirflow.shared import materialised

LARGE = 1_000_000
BUCKETS = 1024
#: Ranks asked for (at most rows / ``LARGE`` groups, two ranks a share) up to which their ranges go to the tasks, so that no group's rows are brought to one task.
SENT = 100_000


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: Expr, shares: dict[str, float], nearest: bool = False, large: int = LARGE) -> DataFrame:
    """keys and a column for each share (name -> 0 to 1): interpolated between the two rows around it as a double, or the ``nearest`` rank's own value.

    Null, NaN and infinite values are left out, and so are groups without others. Null keys are a group.
    """
    if any(not 0 <= p <= 1 for p in shares.values()):
        raise ValueError("a share is between 0 and 1")
    given = df.select(*keys, as_column(value).alias("_v"))
    real = F.col("_v").cast("double")
    rows = given.where(real.isNotNull() & ~F.isnan(real) & (F.abs(real) != math.inf))
    sizes = materialised(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(a + k).eqNullSafe(F.col(b + k)) for k in keys], F.lit(True))
    named = lambda d, p: d.withColumnsRenamed({k: p + k for k in keys})
    big = sizes.where(F.col("_n") > large)
    n_big = big.count()
    hint = F.broadcast if n_big * 2 * max(len(shares), 1) <= SENT else lambda d: d
    few = rows if not n_big else rows.join(hint(named(big.select(*keys), "_s_")), same("", "_s_"), "left_anti") if keys else rows.limit(0)
    if nearest:
        small = few.groupBy(*keys).agg(*[F.expr(f"percentile_disc({float(p)!r}) WITHIN GROUP (ORDER BY _v)").alias(n) for n, p in shares.items()])
    else:
        small = few.groupBy(*keys).agg(*[F.percentile("_v", p).alias(n) for n, p in shares.items()])
    if not n_big:
        return small if keys else small.where(F.col(next(iter(shares))).isNotNull())
    found = selected(rows, named(big, "_t_").select(*[f"_t_{k}" for k in keys], "_n", "_lo", "_hi"), keys, [p for p in shares.values()], nearest, same, hint)
    out = []
    for name, p in shares.items():
        at = lambda r: F.max(F.when(F.col("_rank") == r, F.col("_lo")))
        if nearest:
            out.append(at(_nearest(p)).alias(name))
        else:
            place = F.lit(p) * (F.col("_n") - 1)
            lower, upper = F.max(F.when(F.col("_rank") == F.floor(place), F.col("_lo"))).cast("double"), F.max(F.when(F.col("_rank") == F.ceil(place), F.col("_lo"))).cast("double")
            part = F.max(place - F.floor(place))
            out.append(F.when(part == 0, lower).otherwise(lower * (1 - part) + upper * part).alias(name))
    large_ones = found.groupBy(*[F.col(f"_t_{k}").alias(k) for k in keys]).agg(*out)
    return large_ones.unionByName(small) if keys else large_ones


def _nearest(p: float) -> Column:
    """Rank from 0 of the least row whose share of rows up to it reaches p."""
    return F.greatest(F.ceil(F.lit(p) * F.col("_n")).cast("long") - 1, F.lit(0).cast("long"))


def _magnitude(c: Column) -> Column:
    """About even in powers of two. Square roots are rounded rightly, so this never falls as ``c`` rises."""
    size = F.abs(c.cast("double"))
    for _ in range(10):
        size = F.sqrt(size)
    return F.signum(c.cast("double")) * size


def _part(at: Column, span: Column) -> Column:
    """Which of ``BUCKETS`` parts; the first one where the span is lost in rounding or beyond a double."""
    share = F.coalesce(F.nanvl(at / F.nullif(span, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def selected(rows: DataFrame, groups: DataFrame, keys: Sequence[str], shares: Sequence[float], nearest: bool, same, hint) -> DataFrame:
    """The value (``_lo``) at each rank that the shares need of each group."""
    ranks = []
    for p in shares:
        place = F.lit(p) * (F.col("_n") - 1)
        ranks += [_nearest(p)] if nearest else [F.floor(place).cast("long"), F.ceil(place).cast("long")]
    kind = rows.schema["_v"].dataType
    wide = (lambda c: c.cast("decimal(20,0)")) if kind.typeName() in ("byte", "short", "integer", "long") else (lambda c: c)
    todo = groups.withColumn("_rank", F.explode(F.array_distinct(F.array(*ranks)))).withColumn("_left", F.col("_rank"))
    names = [f"_t_{k}" for k in keys]
    done = None
    while True:
        todo = materialised(todo)
        closed = todo.where("_lo = _hi")
        done = closed if done is None else done.unionByName(closed)
        todo = todo.where("_lo < _hi")
        if todo.isEmpty():
            return done.select(*names, "_n", "_rank", "_lo")
        # ranges of a group are the same or have no value in common: each is counted once for all of its ranks
        ranges = todo.select(*names, "_lo", "_hi").distinct()
        near = rows.join(hint(ranges), same("", "_t_") & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        off = lambda a, b: (wide(F.col(a)) - wide(F.col(b))).cast("double")
        ratio = lambda a, b: _magnitude(F.col(a)) - _magnitude(F.col(b))
        bucket = _part(off("_v", "_lo"), off("_hi", "_lo")) + _part(ratio("_v", "_lo"), ratio("_hi", "_lo"))  # rises with the value, as both do
        counted = near.groupBy(*names, F.col("_lo").alias("_from"), bucket.alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        w = Window.partitionBy(*names, "_from").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)  # at most twice BUCKETS rows
        upto = counted.withColumn("_u", F.sum("_c").over(w)).withColumnsRenamed({k: f"_c{k}" for k in names})
        ranks_of = todo.select(*names, "_n", "_rank", "_left", F.col("_lo").alias("_at"))
        own = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_c{k}")) for k in names], F.col("_at") == F.col("_from"))
        inside = (F.col("_left") < F.col("_u")) & (F.col("_left") >= F.col("_u") - F.col("_c"))
        todo = upto.join(hint(ranks_of), own & inside).select(*names, "_n", "_lo", "_hi", "_rank", (F.col("_left") - (F.col("_u") - F.col("_c"))).alias("_left"))
