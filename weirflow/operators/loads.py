"""Load strategies as plans: the next content of a target from its present content and what arrives.

Files of a plain table cannot be updated in place, so a merge is a join and a rewrite; ``save`` writes beside the
target and then moves, so that a plan may read what it replaces.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators.rows import Expr, as_column


def _match(keys: Sequence[str], left: str = "", right: str = "_s_") -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & (F.col(left + k) == F.col(right + k))
    return test


def check_unique(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The source with one row for each key, or an error when the plan runs: a merge must not match a row twice. Rows with a null in their key match nothing and stay, however many."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    one = source.where(whole).groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*source.columns)).alias("_row"))
    sure = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several source rows have the key "), F.to_json(F.struct(*keys))))).otherwise(F.col("_row"))
    return one.select(sure.alias("_row")).select("_row.*").unionByName(source.where(~whole))


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], action: str | None = None, delete: Expr | None = None, update: Expr | None = None, insert: Expr | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """MERGE: matched rows are deleted, else updated, and unmatched ones inserted, each where its condition allows.

    A null in a key matches nothing: such source rows are unmatched ones, and such target rows stay. Conditions see source columns as s.<name> and target columns as t.<name>. Instead, ``action`` names a column of
    the source with INSERT, UPDATE, DELETE or REJECT. Without keys nothing can match, so the target is rebuilt from the source, with a warning. ``columns`` limits what an update changes (keys never change).
    """
    names = target.columns
    if not keys:
        warnings.warn("a merge without keys rebuilds the target from the source", stacklevel=2)
        rows = source if action is None else source.filter(F.col(action).isin("INSERT", "UPDATE"))
        return rows.select(*[F.col(c) if c in source.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in names])
    src = check_unique(source, keys)
    t = target.select(F.struct(*names).alias("t"), *[F.col(k).alias(f"_t_{k}") for k in keys])
    s = src.select(F.struct(*src.columns).alias("s"), *[F.col(k).alias(f"_s_{k}") for k in keys])
    both = t.join(s, _match(keys, "_t_"), "full")
    given = F.col("s").isNotNull()
    here = F.col("t").isNotNull()
    is_ = lambda a, c: (F.col(f"s.{action}") == a) if action else (F.lit(True) if c is None else as_column(c))
    yes = lambda c: F.coalesce(c, F.lit(False))
    gone = here & given & yes(is_("DELETE", F.lit(False) if delete is None else delete))
    changed = here & given & yes(is_("UPDATE", update))
    added = ~here & given & yes(is_("INSERT", insert))
    fixed = set(keys) if columns is None else set(names) - set(columns)
    new = [F.when(added, F.col(f"s.{c}") if c in src.columns else F.lit(None)).when(changed & F.lit(c not in fixed and c in src.columns), F.col(f"s.{c}") if c in src.columns else F.lit(None)).otherwise(F.col(f"t.{c}")).alias(c) for c in names]
    return both.filter(~gone & (here | added)).select(*new)


def update_rows(df: DataFrame, changes: Mapping[str, Expr], where: Expr) -> DataFrame:
    """UPDATE ... SET ... WHERE: rows for which the condition is not true stay as they are; right sides see the old values."""
    hit = F.coalesce(as_column(where), F.lit(False))
    return df.select(*[F.when(hit, as_column(changes[c]).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns])


def delete_rows(df: DataFrame, where: Expr) -> DataFrame:
    """DELETE WHERE: rows for which the condition is true go; unknown ones stay."""
    return df.filter(~F.coalesce(as_column(where), F.lit(False)))


def with_statements(spark: SparkSession, load: Callable[[], object], before: Sequence[str] = (), after: Sequence[str] = ()) -> object:
    """A load between SQL statements; those behind it run only if it succeeds."""
    for statement in before:
        spark.sql(statement)
    done = load()
    for statement in after:
        spark.sql(statement)
    return done


def delete_insert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All target rows whose key arrives go, and all that arrives is added, repeated keys too."""
    arriving = source.select(*[F.col(k).alias(f"_s_{k}") for k in keys])
    return target.join(arriving, _match(keys), "left_anti").unionByName(source.select(*target.columns))


def append(target: DataFrame, source: DataFrame) -> DataFrame:
    return target.unionByName(source.select(*target.columns))


def scd1(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """New keys are inserted, changed columns overwritten, others left; nulls differ from values."""
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    return merge(target, source, keys, update=changed, columns=columns)


def scd2(target: DataFrame, source: DataFrame, keys: Sequence[str], now: object, columns: Sequence[str] | None = None, updated_at: str | None = None, start: str = "valid_from", end: str = "valid_to", flag: str | None = "is_current", yes: object = True, no: object = False, surrogate: str | None = None) -> DataFrame:
    """Changed keys close their current row (end = now) and get a new one (start = now, no end).

    A change is any of ``columns`` that differs, nulls included (check), or a greater ``updated_at`` (timestamp). Keys
    are the business keys. Keys that do not arrive stay as they are. New surrogates continue after the greatest one.
    """
    names = target.columns
    src = check_unique(source, keys)
    s = src.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.struct(*src.columns).alias("s"))
    current = F.col(flag) == F.lit(yes) if flag else F.col(end).isNull()
    old = target.join(s, _match(keys) & current, "left")
    if updated_at:
        differs = F.col(f"s.{updated_at}") > F.col(updated_at)
    else:
        differs = F.lit(False)
        for c in columns or [c for c in src.columns if c not in keys]:
            differs = differs | ~F.col(f"s.{c}").eqNullSafe(F.col(c))
    closes = F.col("s").isNotNull() & F.coalesce(differs, F.lit(False))
    at = F.lit(now).cast(target.schema[start].dataType)
    kept = old.select(*[F.when(closes, at).otherwise(F.col(c)).alias(c) if c == end else F.when(closes, F.lit(no)).otherwise(F.col(c)).alias(c) if c == flag else F.col(c) for c in names])
    held = target.filter(current)
    new = src.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.struct(*src.columns).alias("s")).join(held, _match(keys), "left")
    opens = new.filter(F.col(keys[0]).isNull() | F.coalesce(differs, F.lit(False)))
    made = {start: at, end: F.lit(None).cast(target.schema[end].dataType)} | ({flag: F.lit(yes)} if flag else {})
    opens = opens.select(*[(made[c] if c in made else F.col(f"s.{c}") if c in src.columns else F.lit(None).cast(target.schema[c].dataType)).alias(c) for c in names])
    if surrogate:
        from weirflow.operators.aggregates import sequence

        top = target.agg(F.max(surrogate)).first()[0] or 0
        opens = sequence(opens.drop(surrogate), surrogate, keys[0], keys[1:], start=top + 1).select(*names)
    return kept.unionByName(opens)


def scd2_checks(table: DataFrame, keys: Sequence[str], start: str = "valid_from", end: str = "valid_to", flag: str = "is_current", yes: object = True) -> DataFrame:
    """check and violations: one current row for each key, start before end, and a flag that agrees with the end."""
    current = F.col(flag) == F.lit(yes)
    many = table.filter(current).groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("violations")).select(F.lit("current_uniqueness").alias("check"), "violations")
    counted = table.agg(F.count_if(F.col(end) < F.col(start)).alias("date_range"), F.count_if((current & F.col(end).isNotNull()) | (~current & F.col(end).isNull())).alias("flag_end_agreement"))
    return many.unionByName(counted.selectExpr("stack(2, 'date_range', date_range, 'flag_end_agreement', flag_end_agreement) as (check, violations)"))


def rejects(df: DataFrame, action: str = "row_action") -> tuple[DataFrame, DataFrame]:
    """The rows to load and those to reject."""
    bad = F.coalesce(F.col(action) == "REJECT", F.lit(False))
    return df.filter(~bad), df.filter(bad)


def save(df: DataFrame, path: str, mode: str = "full", format: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Writes a load: full (replaces; the plan may read ``path`` itself) or append.

    A full load is written beside the target and moved into its place in two renames. A run that dies between them leaves
    the old content as ``<path>.old-...`` only; the next save, or ``recover``, puts it back. Where renames copy (object stores) readers can
    see neither for that long; write to a table format there.
    """
    writer = lambda p, m: df.write.mode(m).partitionBy(*partition_by).format(format).save(p)
    if mode == "append":
        writer(path, "append")
        return
    if mode != "full":
        raise ValueError("mode is full or append")
    spark = df.sparkSession
    recover(spark, path)
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    writer(new, "error")
    place, fs = _files(spark, path)
    there = fs.exists(place(path))
    if there and not fs.rename(place(path), place(old)):
        raise OSError(f"{path} could not be moved to {old}; the new content is {new}")
    if not fs.rename(place(new), place(path)):
        if there:
            fs.rename(place(old), place(path))
        raise OSError(f"{new} could not be moved to {path}")
    if there:
        fs.delete(place(old), True)
    spark.catalog.refreshByPath(path)


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return place, place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def recover(spark: SparkSession, path: str) -> bool:
    """Puts back what a save that died between its renames has left beside ``path``; whether there was anything."""
    place, fs = _files(spark, path)
    if fs.exists(place(path)):
        return False
    left = fs.globStatus(place(f"{path}.old-*"))
    return bool(left) and fs.rename(left[0].getPath(), place(path))
