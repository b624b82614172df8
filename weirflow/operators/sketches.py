"""Sketches as state: distinct counts and quantiles that are merged over loads, which sums and extremes alone cannot be.

A state is a table with one binary column for each measure. Fresh rows are sketched by themselves (in each task first, so a hot key is no hot task) and merged with the state; no earlier row is
read again. Distinct counts are HyperLogLog sketches of 2^``LOG_K`` registers: a relative standard error of 1.04 / sqrt(2^LOG_K), 0.8 percent. Quantiles are KLL sketches: the rank of what is
returned is off by about 1.3 percent at k = 200, and by less with ``RANK_K`` = 800. Nulls are not counted. Merging a load twice leaves distinct counts as they are, but not quantiles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.operators.order import Expr
from weirflow.operators.rows import as_column

LOG_K = 14
RANK_K = 800
KINDS = ("distinct", "quantiles")


def _known(measures: Mapping[str, tuple[str, Expr]]) -> None:
    if bad := [kind for kind, _ in measures.values() if kind not in KINDS]:
        raise ValueError(f"no such sketch: {', '.join(bad)}; there are {', '.join(KINDS)}")


def sketched(df: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple[str, Expr]]) -> DataFrame:
    """The state of one load. measures: name -> (distinct or quantiles, expression); quantiles are of numbers, as doubles."""
    _known(measures)
    made = []
    for name, (kind, e) in measures.items():
        c = as_column(e)
        if kind == "distinct":
            text = df.select(c.alias("c")).schema["c"].dataType.typeName()
            c = c if text in ("string", "binary", "integer", "long") else c.cast("string")
            made.append(F.hll_sketch_agg(c, LOG_K).alias(name))
        else:
            made.append(F.kll_sketch_agg_double(c.cast("double"), RANK_K).alias(name))
    return df.groupBy(*keys).agg(*made)


def merged(states: Sequence[DataFrame], keys: Sequence[str], measures: Mapping[str, tuple[str, Expr]]) -> DataFrame:
    """One state of several; keys of any of them."""
    _known(measures)
    both = states[0].select(*keys, *measures)
    for s in states[1:]:
        both = both.unionByName(s.select(*keys, *measures))
    made = [(F.hll_union_agg(name) if kind == "distinct" else F.kll_merge_agg_double(name, RANK_K)).alias(name) for name, (kind, _) in measures.items()]
    return both.groupBy(*keys).agg(*made)


def estimates(state: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple[str, Expr]], ranks: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """keys, the estimated number of distinct values of each distinct measure, and an array of values at ``ranks`` of each quantiles measure (null if there were none)."""
    _known(measures)
    made = []
    for name, (kind, _) in measures.items():
        if kind == "distinct":
            made.append(F.hll_sketch_estimate(name).alias(name))
        else:
            some = F.kll_sketch_get_n_double(name) > 0
            made.append(F.when(some, F.array(*[F.kll_sketch_get_quantile_double(F.when(some, F.col(name)), F.lit(float(r))) for r in ranks])).alias(name))
    return state.select(*keys, *made)
