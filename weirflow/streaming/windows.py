"""Windowed aggregation, which runs alike on streams and on tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.operators.rows import Expr, as_column

#: Lateness that is allowed where a job declares none.
DEFAULT_DELAY = "30 seconds"
KINDS = ("tumbling", "hopping", "sliding", "session", "global")


def window_column(kind: str, time: str, size: str | None = None, slide: str | None = None, gap: str | None = None) -> Column | None:
    """The window of a row; None for the global one. A session ends after the longer of gap and size."""
    if kind == "tumbling":
        return F.window(time, size)
    if kind in ("hopping", "sliding"):
        if not slide:
            raise ValueError(f"a {kind} window needs a slide")
        return F.window(time, size, slide)
    if kind == "session":
        return F.session_window(time, max((x for x in (gap, size) if x), key=pd.Timedelta))
    if kind == "global":
        return None
    raise ValueError(f"no such window: {kind}; there are {', '.join(KINDS)}")


def windowed(df: DataFrame, kind: str, time: str, keys: Sequence[str], aggregates: Mapping[str, Expr], size: str | None = None, slide: str | None = None, gap: str | None = None, delay: str | None = None) -> DataFrame:
    """window_start, window_end, keys and aggregates. On a stream late rows are dropped beyond the delay (30 seconds if none is given)."""
    w = window_column(kind, time, size, slide, gap)
    if df.isStreaming and w is not None:
        df = df.withWatermark(time, delay or DEFAULT_DELAY)
    aggs = [as_column(e).alias(k) for k, e in aggregates.items()]
    if w is None:
        return df.groupBy(*keys).agg(*aggs)
    return df.groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def deduplicated(df: DataFrame, keys: Sequence[str], time: str, delay: str = DEFAULT_DELAY) -> DataFrame:
    """One row for each key; on a stream within the watermark, so that its state is bounded."""
    if df.isStreaming:
        return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, within: str, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Rows of equal keys whose right time follows the left one within an interval such as 10 minutes; watermarks bound the state of a stream.

    Other columns of the two sides, the times among them, need different names.
    """
    if left.isStreaming:
        left = left.withWatermark(left_time, delay)
    if right.isStreaming:
        right = right.withWatermark(right_time, delay)
    test = F.expr(f"{right_time} >= {left_time} AND {right_time} <= {left_time} + INTERVAL {within}")
    for k in keys:
        test = test & (F.col(k) == F.col(f"_right_{k}"))
    return left.join(right.withColumnsRenamed({k: f"_right_{k}" for k in keys}), test).drop(*[f"_right_{k}" for k in keys])


def split_bad(df: DataFrame, valid: Expr) -> tuple[DataFrame, DataFrame]:
    """Good rows, and those for a dead-letter sink; a null test is bad."""
    ok = F.coalesce(as_column(valid), F.lit(False))
    return df.filter(ok), df.filter(~ok)
