"""Projections, filters, routing and reshaping: operators that look at one row at a time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.order import Expr, Order, sort_columns


def as_column(x: Expr) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def project(df: DataFrame, ports: Mapping[str, Expr | None]) -> DataFrame:
    """EXPRESSION: an output for each port; None passes the column of that name through."""
    return df.select(*[(F.col(name) if e is None else as_column(e)).alias(name) for name, e in ports.items()])


def add_ports(df: DataFrame, ports: Mapping[str, Expr]) -> DataFrame:
    """Pass-through EXPRESSION: all columns and new ones."""
    return df.withColumns({k: as_column(e) for k, e in ports.items()})


def with_variables(df: DataFrame, variables: Mapping[str, Expr], outputs: Mapping[str, Expr | None]) -> DataFrame:
    """Variable ports are evaluated from top to bottom, may use those above them, and are not projected."""
    for name, e in variables.items():
        df = df.withColumn(name, as_column(e))
    return project(df, outputs)


def running(df: DataFrame, order: Sequence[Expr | Order], keys: Sequence[str] = (), ranges: int | None = None, **ports: tuple[str, Expr]) -> DataFrame:
    """Stateful variables in a declared order. ports: name=(kind, expression); kinds previous, sum, count, min, max, last (of the values that are not null).

    With keys, windows over them. Without, or where ``ranges`` are given because a key holds a large share of the rows, the order is cut into ranges (``scan``).
    """
    if not order:
        raise ValueError("a stateful port needs a declared order")
    if not keys or ranges:
        from weirflow.operators.scan import scan

        return scan(df, order, keys, ranges, **ports)
    w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    kinds = {"previous": lambda e: F.lag(e).over(w), "sum": lambda e: F.sum(e).over(frame), "count": lambda e: F.count(e).over(frame), "min": lambda e: F.min(e).over(frame), "max": lambda e: F.max(e).over(frame), "last": lambda e: F.last(e, ignorenulls=True).over(frame)}
    return df.withColumns({name: kinds[kind](as_column(e)) for name, (kind, e) in ports.items()})


def keep(df: DataFrame, condition: Expr) -> DataFrame:
    """FILTER: rows for which the condition is true; null drops the row. A number counts as true if it is not 0."""
    c = as_column(condition)
    if df.select(c.alias("c")).schema["c"].dataType.typeName() != "boolean":
        c = c != 0
    return df.filter(c)


def newer_than(df: DataFrame, column: str, target: DataFrame | None, target_column: str | None = None) -> DataFrame:
    """Incremental filter: rows above the greatest value that the target holds; all of them on the first run."""
    last = None if target is None else target.agg(F.max(target_column or column)).first()[0]
    return df if last is None else df.filter(F.col(column) > F.lit(last))


def route(df: DataFrame, groups: Mapping[str, Expr], default: str | None = "DEFAULT", mode: str = "all", label: str = "route_group") -> DataFrame:
    """ROUTER as one pass: each row once for every group whose condition holds, or for the first (mode 'first').

    Rows for which none is true, null conditions included, go to the default group, or nowhere if it is None.
    """
    tests = [(name, F.coalesce(as_column(c), F.lit(False))) for name, c in groups.items()]
    if mode == "first":
        chain = F.when(tests[0][1], tests[0][0])
        for name, c in tests[1:]:
            chain = chain.when(c, name)
        df = df.withColumn(label, chain.otherwise(F.lit(default)))
        return df if default is not None else df.filter(F.col(label).isNotNull())
    if mode != "all":
        raise ValueError("mode is 'all' or 'first'")
    hits = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in tests]), lambda x: x.isNotNull())
    if default is not None:
        hits = F.when(F.size(hits) == 0, F.array(F.lit(default))).otherwise(hits)
    return df.withColumn(label, F.explode(hits))


def split(df: DataFrame, groups: Mapping[str, Expr], default: str | None = "DEFAULT") -> dict[str, DataFrame]:
    """ROUTER as one lazy branch for each group."""
    tests = {name: F.coalesce(as_column(c), F.lit(False)) for name, c in groups.items()}
    out = {name: df.filter(c) for name, c in tests.items()}
    if default is not None:
        none = F.lit(True)
        for c in tests.values():
            none = none & ~c
        out[default] = df.filter(none)
    return out


ACTIONS = ("INSERT", "UPDATE", "DELETE", "REJECT")


def update_strategy(df: DataFrame, rules: Sequence[tuple[Expr, str | int]], otherwise: str | int = "REJECT", action: str = "row_action") -> DataFrame:
    """UPDATE_STRATEGY: the action of the first rule that is true; a null condition falls through to the next."""
    name = lambda a: ACTIONS[a] if isinstance(a, int) else a.removeprefix("DD_")
    chain: Column | None = None
    for c, a in rules:
        if name(a) not in ACTIONS:
            raise ValueError(f"no such action: {a}")
        chain = (F if chain is None else chain).when(as_column(c), name(a))
    return df.withColumn(action, F.lit(name(otherwise)) if chain is None else chain.otherwise(name(otherwise)))


def union_by_position(frames: Sequence[DataFrame], names: Sequence[str] | None = None, distinct: bool = False) -> DataFrame:
    """UNION: rows of all inputs by position; the first or ``names`` names the columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    out = out.toDF(*names) if names else out
    return out.distinct() if distinct else out


NUMERIC = frozenset(("byte", "short", "integer", "long", "float", "double", "decimal"))
TEMPORAL = frozenset(("date", "timestamp", "timestamp_ntz"))


def union_check(frames: Sequence[DataFrame]) -> list[tuple[int, str]]:
    """For each position: same, implicit (numbers or times among themselves) or incompatible."""
    if len({len(f.columns) for f in frames}) != 1:
        raise ValueError("the inputs have different numbers of columns")
    out = []
    for i in range(len(frames[0].columns)):
        kinds = {f.schema[i].dataType.simpleString() for f in frames}
        names = {f.schema[i].dataType.typeName() for f in frames}
        out.append((i, "same" if len(kinds) == 1 else "implicit" if names <= NUMERIC or names <= TEMPORAL else "incompatible"))
    return out


def normalize(df: DataFrame, groups: Mapping[str, Sequence[str]], keep_columns: Sequence[str], occurrence: str = "gcid") -> DataFrame:
    """NORMALIZER: repeating groups to rows, nulls included; ``occurrence`` counts from 1. groups: output -> columns in order."""
    lengths = {len(v) for v in groups.values()}
    if len(lengths) != 1:
        raise ValueError("the repeating groups differ in length")
    n = lengths.pop()
    rows = F.array(*[F.struct(F.lit(i + 1).alias(occurrence), *[F.col(cols[i]).alias(out) for out, cols in groups.items()]) for i in range(n)])
    return df.select(*keep_columns, F.explode(rows).alias("_r")).select(*keep_columns, f"_r.{occurrence}", *[f"_r.{out}" for out in groups])


def normalize_keyed(df: DataFrame, groups: Mapping[str, Sequence[str]], keep_columns: Sequence[str], order: Sequence[str], generated: str = "gk", start: int = 1, occurrence: str = "gcid") -> DataFrame:
    """NORMALIZER with a generated key: a number for each input row in the declared order, shared by its occurrences."""
    from weirflow.operators.aggregates import sequence

    keyed = sequence(df, generated, order[0], order[1:], start)
    return normalize(keyed, groups, [*keep_columns, generated], occurrence)


def first_rows(df: DataFrame, n: int, order: Sequence[Expr | Order] = ()) -> DataFrame:
    """ROWNUM <= n: any n rows, taken before they are sorted."""
    out = df.limit(n)
    return out.orderBy(*sort_columns(order)) if order else out


def parse_fields(df: DataFrame, column: str, pattern: str, names: Sequence[str], rejected: str | None = None) -> DataFrame:
    """PARSER: the groups of a pattern that fits the whole text as columns, null where it does not; ``rejected`` names a flag for those."""
    fits = F.coalesce(F.col(column).rlike(f"^(?:{pattern})$"), F.lit(False))
    out = df.withColumns({n: F.when(fits, F.regexp_extract(column, f"^(?:{pattern})$", i)) for i, n in enumerate(names, 1)})
    return out.withColumn(rejected, ~fits) if rejected else out


def parse_xml(df: DataFrame, column: str, schema: str, into: str = "parsed") -> DataFrame:
    """XML_PARSER: a text column as a struct, null where it is no XML or does not fit the schema."""
    read = F.from_xml(F.col(column), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    fields = [f.name for f in df.select(F.from_xml(F.col(column), schema).alias("x")).schema["x"].dataType]
    out = df.withColumn("_xml", read)
    good = F.col("_xml").isNotNull() & F.col("_xml._bad").isNull()
    return out.withColumn(into, F.when(good, F.struct(*[F.col("_xml").getField(f).alias(f) for f in fields]))).drop("_xml")


def render_xml(df: DataFrame, columns: Sequence[str], row_tag: str, into: str = "xml") -> DataFrame:
    """XML_GENERATOR: columns of each row as an XML text."""
    return df.withColumn(into, F.to_xml(F.struct(*columns), {"rowTag": row_tag}))


def denormalize(df: DataFrame, keys: Sequence[str], pivot: str, values: Sequence[object], aggregates: Mapping[str, str]) -> DataFrame:
    """Pivot with declared values, so that no pass is needed to find them; columns are <value>_<name>. aggregates: name -> SQL."""
    aggs = [F.expr(f"{a} FILTER (WHERE {pivot} = {_literal(v)})").alias(f"{v}_{name}") for v in values for name, a in aggregates.items()]
    return df.groupBy(*keys).agg(*aggs)


def _literal(v: object) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)
