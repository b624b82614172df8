"""Joins and lookups. The physical strategy is Spark's: no hints, as sizes are known to its statistics at run time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.order import Order, rank_key, sort_columns
from weirflow.operators.rows import Expr, as_column
from weirflow.shared import materialised

HOW = {"inner": "inner", "normal": "inner", "left": "left", "master outer": "left", "right": "right", "detail outer": "right", "full": "full", "full outer": "full"}


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]] | Sequence[str], how: str = "inner", condition: Expr | None = None, left_prefix: str = "", right_prefix: str = "r_") -> DataFrame:
    """JOINER: equal columns, and a further condition over the columns as they are named in the result.

    ``how`` takes the usual names or those of master and detail inputs, detail being the left. Columns of
    both sides that have one name get the prefixes; join columns of one name stay one, filled from whichever
    side has the row.
    """
    kind = HOW[how.lower()]
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in on]
    same = {a for a, b in pairs if a == b}
    clash = {c for c in left.columns if c in set(right.columns)} - same
    l_names = {c: (left_prefix + c if c in clash else c) for c in left.columns}
    r_names = {c: (right_prefix + c if c in clash else f"_right_{c}" if c in same else c) for c in right.columns}
    l = left.select(*[F.col(c).alias(n) for c, n in l_names.items()])  # noqa: E741
    r = right.select(*[F.col(c).alias(n) for c, n in r_names.items()])
    test = F.lit(True)
    for a, b in pairs:
        test = test & (F.col(l_names[a]) == F.col(r_names[b]))
    if condition is not None:
        test = test & as_column(condition)
    out = l.join(r, test, kind) if pairs or condition is not None else l.crossJoin(r)
    shown = [(F.coalesce(F.col(c), F.col(f"_right_{c}")) if kind in ("right", "full") and c in same else F.col(n)).alias(n) for c, n in l_names.items()]
    return out.select(*shown, *[n for c, n in r_names.items() if c not in same])


def semi(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """EXISTS."""
    return left.join(_keys(right, on), _equal(on), "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """NOT EXISTS; with foreign keys, the orphans. Rows with a null key are kept."""
    return left.join(_keys(right, on), _equal(on), "left_anti")


def _keys(right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    return right.select(*[F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(on)])


def _equal(on: Sequence[tuple[str, str]]) -> Column:
    test = F.lit(True)
    for i, (a, _) in enumerate(on):
        test = test & (F.col(a) == F.col(f"_k{i}"))
    return test


def lookup(df: DataFrame, table: DataFrame, on: Sequence[tuple[str, str]], returns: Mapping[str, str], match: str = "first", order: Sequence[Expr | Order] = (), source_filter: Expr | None = None) -> DataFrame:
    """LOOKUP: every input row with the columns that the table returns for its keys, null where there is none.

    match: first, last or any single row by the declared order (any needs none), or all rows. returns: output -> table column.
    The single rows are chosen by an aggregate with map-side minima, so a key with many rows is no hot task.
    """
    table = table if source_filter is None else table.filter(as_column(source_filter))
    keys = [F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(on)]
    values = F.struct(*[F.col(c).alias(n) for n, c in returns.items()])
    if match == "all":
        right = table.select(*keys, values.alias("_v"))
    else:
        if match in ("first", "last") and not order:
            raise ValueError("first and last need a declared order")
        by = rank_key(table, order)
        pick = F.max_by if match == "last" else F.min_by
        right = table.groupBy(*keys).agg(pick(values, by).alias("_v"))
    return df.join(right, _equal(on), "left").select(*df.columns, *[F.col("_v").getField(n).alias(n) for n in returns])


def top_per_row(df: DataFrame, table: DataFrame, on: Sequence[tuple[str, str]], order: Sequence[Expr | Order], n: int, returns: Mapping[str, str], outer: bool = False) -> DataFrame:
    """CROSS APPLY (outer: OUTER APPLY) of the first n rows of the table for each row's keys. Spark keeps the first n of a key in each task before it shuffles."""
    w = Window.partitionBy(*[F.col(b) for _, b in on]).orderBy(*sort_columns(order))
    right = table.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    right = right.select(*[F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(on)], *[F.col(c).alias(name) for name, c in returns.items()])
    return df.join(right, _equal(on), "left" if outer else "inner").select(*df.columns, *returns)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, returns: Sequence[str], ties: Sequence[Expr | Order] = (), ranges: int | None = None) -> DataFrame:
    """Each left row with the latest right row of its keys at or before its time: one shuffle of both by the keys, no range join.

    Of right rows of one time the last by ``ties``, an order over the right columns, counts. Without keys, or with ``ranges`` because a key holds a large share of the rows,
    both sides' rows are dealt out by ranges of the order instead (``scan``). Null times come first, and a row with one sees those of the other side only.
    """
    tie = rank_key(right, ties)
    l = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*returns)).schema[0].dataType).alias("_r"), F.lit(None).cast(right.select(tie).schema[0].dataType).alias("_tie_of"))  # noqa: E741
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.struct(*returns).alias("_r"), tie.alias("_tie_of"))
    both = l.unionByName(r)
    if keys and not ranges:
        w = Window.partitionBy(*keys).orderBy("_t", "_side", "_tie_of").rowsBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("_last", F.last("_r", ignorenulls=True).over(w))
    else:
        from weirflow.operators.scan import scan

        out = scan(both, ["_t", "_side", "_tie_of"], keys, ranges, _last=("last", "_r"))
    return out.filter("_side = 1").select("_l.*", *[F.col("_last").getField(c).alias(c) for c in returns])


def hierarchy(df: DataFrame, key: str, parent: str, start: Expr, carry: Sequence[str] = (), level: str = "level", deepest: int | None = None) -> DataFrame:
    """CONNECT BY: rows from the start rows down, with their level (``deepest`` at most, if given) and the path of keys.

    One join a level, cut by a checkpoint. A key that a path holds already
    is not entered again, so cycles end.
    """
    rows = df.select(key, parent, *carry)
    front = rows.filter(as_column(start)).withColumn(level, F.lit(1)).withColumn("path", F.array(F.col(key).cast("string")))
    out = front
    for depth in count(2) if deepest is None else range(2, deepest + 1):
        up = front.select(F.col(key).alias("_up"), F.col("path").alias("_path"))
        front = rows.join(up, F.col(parent) == F.col("_up")).filter(~F.array_contains("_path", F.col(key).cast("string")))
        front = front.select(key, parent, *carry, F.lit(depth).alias(level), F.concat("_path", F.array(F.col(key).cast("string"))).alias("path"))
        front = materialised(front)
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out.withColumn("path", F.array_join("path", "/"))


def dynamic_lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], order: Sequence[Expr | Order], columns: Sequence[str], flag: str = "new_lookup_row") -> tuple[DataFrame, DataFrame]:
    """LOOKUP with a cache that rows add to: the rows with what the table holds for their keys, and the table afterwards.

    Of a key that the table lacks, the first row in the declared order is added (``flag`` 1) and later ones see its values
    (``flag`` 0). Of rows of equal rank the least row as a whole is the first, and of equal rows any single one. Keys are equal if both are null. The first rows come
    from an aggregate with map-side minima, so a hot key is no hot task.
    """
    if not order:
        raise ValueError("a dynamic lookup needs a declared order")
    row = F.struct(*df.columns)
    at = F.struct(rank_key(df, order).alias("rank"), row.alias("row"))
    first = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(at).getField("row").alias("_first"))
    held = table.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.struct(*columns).alias("_held"))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(a(i, k)).eqNullSafe(F.col(b(i, k))) for i, k in enumerate(keys)])
    known = first.join(held, same(lambda i, _: f"_k{i}", lambda i, _: f"_h{i}"), "left")
    seen = df.join(known, same(lambda _, k: k, lambda i, _: f"_k{i}"))
    adds = F.col("_held").isNull() & row.eqNullSafe(F.col("_first"))
    rest = [c for c in df.columns if c not in set(columns)]
    shown = lambda rows, new: rows.select(*rest, *[F.coalesce(F.col("_held").getField(c), F.when(F.col("_held").isNull(), F.col("_first").getField(c))).alias(c) for c in columns], new.cast("int").alias(flag))
    # equal rows that all come first: counted, and one of them adds
    equal = seen.filter(adds).groupBy(*df.columns, "_held", "_first").agg(F.count("*").alias("_n"))
    equal = equal.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    rows = shown(seen.filter(~adds), F.lit(0)).unionByName(shown(equal, F.col("_copy") == 1))
    added = known.where("_held is null").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[F.col("_first").getField(c).alias(c) for c in columns])
    return rows, table.select(*keys, *columns).unionByName(added)


def fuzzy_match(left: DataFrame, right: DataFrame, block: tuple[Expr, Expr], left_text: str, right_text: str, most: int) -> DataFrame:
    """MATCH: pairs whose texts are at most ``most`` edits apart among those that share a blocking key, with the distance."""
    l = left.withColumn("_block", as_column(block[0]))  # noqa: E741
    r = right.withColumn("_right_block", as_column(block[1]))
    pairs = l.join(r, F.col("_block") == F.col("_right_block")).withColumn("distance", F.levenshtein(left_text, right_text, most))
    return pairs.filter(F.col("distance") >= 0).drop("_block", "_right_block")
