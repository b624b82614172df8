"""Reconciliation of a source and a target, and checks of one table. Each check is one query with a small result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.operators.joins import anti
from weirflow.operators.rows import Expr, as_column

NUMERIC = frozenset(("byte", "short", "integer", "long", "float", "double", "decimal"))


def row_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    a = source.agg(F.count("*").alias("source_rows"))
    return a.crossJoin(target.agg(F.count("*").alias("target_rows"))).withColumn("violations", F.abs(F.col("source_rows") - F.col("target_rows")))


def key_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("violations"))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns or df.columns])


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.groupBy(*(columns or df.columns)).count().filter("count > 1").agg(F.count("*").alias("duplicate_row_groups"))


def totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"), *[x for c in columns for x in (F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_count"))])


def ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[x for c in columns for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))])


def row_text(columns: Sequence[str | Column]) -> Column:
    """The values as text between bars, null as empty."""
    return F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns])


def fingerprint(df: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """row_count and the sum over rows of the first eight hexadecimal digits of their MD5; no order needed."""
    part = F.conv(F.substring(F.md5(row_text(columns)), 1, 8), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("row_count"), F.sum(part).cast("decimal(38,0)").alias("md5_fingerprint"))


def fast_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As fingerprint, by Spark's own hash; to be compared with Spark only."""
    return df.agg(F.count("*").alias("row_count"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("native_checksum"))


def differences(source: DataFrame, target: DataFrame, columns: Sequence[str]) -> DataFrame:
    """side and n_rows: rows that one side has and the other has not, or more often.

    One aggregation of both sides by the columns in place of two set differences.
    """
    both = source.select(*columns, F.lit(1).alias("_s"), F.lit(0).alias("_t")).unionByName(target.select(*columns, F.lit(0).alias("_s"), F.lit(1).alias("_t")))
    counts = both.groupBy(*columns).agg((F.sum("_s") - F.sum("_t")).alias("d")).filter("d <> 0")
    out = counts.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("b"))
    return out.selectExpr("stack(2, 'source_only', a, 'target_only', b) as (side, n_rows)")


def orphans(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    some = F.lit(True)
    for c, _ in on:
        some = some & F.col(c).isNotNull()
    return anti(child.filter(some), parent, on).agg(F.count("*").alias("violations"))


def rules(df: DataFrame, checks: Mapping[str, Expr]) -> DataFrame:
    """rule and violations of row predicates, in one pass. A predicate that is null is no violation, as in SQL's CHECK."""
    counts = df.agg(*[F.count_if(~as_column(c)).alias(f"r{i}") for i, c in enumerate(checks.values())])
    pairs = ", ".join(f"'{k}', r{i}" for i, k in enumerate(checks))
    return counts.selectExpr(f"stack({len(checks)}, {pairs}) as (rule, violations)")


def accepted(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values)).agg(F.count("*").alias("violations"))


def schema_differences(expected: DataFrame, actual: DataFrame) -> list[tuple[str, str]]:
    a, b = dict(expected.dtypes), dict(actual.dtypes)
    return [(c, "missing") for c in a if c not in b] + [(c, "unexpected") for c in b if c not in a] + [(c, f"{a[c]} expected, {b[c]} found") for c in a if c in b and a[c] != b[c]]


def run(checks: Mapping[str, DataFrame]) -> DataFrame:
    """check, status and violations of checks that have one row with a column ``violations``; others are measured."""
    out = None
    for name, df in checks.items():
        if "violations" in df.columns:
            row = df.agg(F.sum("violations").cast("long").alias("violations")).select(F.lit(name).alias("check"), F.when(F.col("violations") == 0, "pass").otherwise("fail").alias("status"), "violations", F.lit(None).cast("string").alias("measured"))
        else:
            row = df.select(F.lit(name).alias("check"), F.lit("measured").alias("status"), F.lit(None).cast("long").alias("violations"), F.to_json(F.struct("*")).alias("measured"))
        out = row if out is None else out.unionByName(row)
    return out


def distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows by route, with their share in percent."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_rows"))
    total = counts.agg(F.sum("n_rows").alias("_total"))  # one row
    return counts.crossJoin(total).select(label, "n_rows", F.round(100 * F.col("n_rows") / F.col("_total"), 2).alias("percent"))


def lookup_misses(df: DataFrame, returned: str) -> DataFrame:
    return df.agg(F.count_if(F.col(returned).isNull()).alias("unmatched"), F.count("*").alias("n_rows"))


def filter_counts(df: DataFrame, condition: Expr) -> DataFrame:
    """Rows that a filter passes, fails and drops as unknown."""
    c = as_column(condition)
    return df.agg(F.count_if(c).alias("passed"), F.count_if(~c).alias("failed"), F.count_if(c.isNull()).alias("unknown"))
