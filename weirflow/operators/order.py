"""Declared orders: expressions with a direction and a place for nulls, alike in sorts, windows, ranges and aggregates.

An order is a text such as ``"amount desc nulls last"``, a plain column, or ``asc(...)`` or ``desc(...)`` of either. As in SQL, nulls
come first in an ascending and last in a descending order unless the order says otherwise. Columns that already carry a direction (``F.desc``)
are refused, as their direction cannot be read back.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Expr = str | Column

SUFFIX = re.compile(r"^(?P<expr>.*?\S)(?:\s+(?P<way>asc|desc))?(?:\s+nulls\s+(?P<nulls>first|last))?\s*$", re.IGNORECASE | re.DOTALL)
SORTED = re.compile(r" (?:ASC|DESC) NULLS (?:FIRST|LAST)'>$")


@dataclass(frozen=True)
class Order:
    """``nulls_first`` is None where the direction decides."""

    expr: Expr
    descending: bool = False
    nulls_first: bool | None = None

    @property
    def column(self) -> Column:
        return F.expr(self.expr) if isinstance(self.expr, str) else self.expr

    @property
    def nulls_lead(self) -> bool:
        return not self.descending if self.nulls_first is None else self.nulls_first

    def sort(self) -> Column:
        """For orderBy, windows and range partitions."""
        c = self.column
        if self.descending:
            return c.desc_nulls_first() if self.nulls_lead else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_lead else c.asc_nulls_last()

    def reversed(self) -> Order:
        return replace(self, descending=not self.descending, nulls_first=not self.nulls_lead)


def order(x: Expr | Order) -> Order:
    """An order of whatever declares one."""
    if isinstance(x, Order):
        return x
    if isinstance(x, Column):
        if SORTED.search(str(x)):
            raise ValueError(f"{x} already has a direction; say asc(...), desc(...) or 'x desc nulls last'")
        return Order(x)
    m = SUFFIX.match(x)
    if not m:
        raise ValueError("an order needs an expression")
    nulls = m["nulls"]
    return Order(m["expr"], (m["way"] or "").lower() == "desc", None if nulls is None else nulls.lower() == "first")


def orders(xs: Expr | Order | Sequence[Expr | Order]) -> list[Order]:
    return [order(x) for x in ([xs] if isinstance(xs, str | Column | Order) else xs)]


def asc(x: Expr, nulls: str | None = None) -> Order:
    return _directed(x, False, nulls)


def desc(x: Expr, nulls: str | None = None) -> Order:
    return _directed(x, True, nulls)


def _directed(x: Expr, descending: bool, nulls: str | None) -> Order:
    if nulls not in (None, "first", "last"):
        raise ValueError("nulls are first or last")
    return Order(order(x).expr, descending, None if nulls is None else nulls == "first")


def sort_columns(xs: Expr | Order | Sequence[Expr | Order]) -> list[Column]:
    return [o.sort() for o in orders(xs)]


def rank_key(df: DataFrame, xs: Expr | Order | Sequence[Expr | Order], plain: bool = False) -> Column:
    """A struct that is less the earlier a row comes in the declared order, for min_by, max_by and comparisons; never null. ``plain``: times as microseconds."""
    fields = []
    for i, o in enumerate(orders(xs)):
        lead = o.column.isNull() if not o.nulls_lead else o.column.isNotNull()
        kind = df.select(o.column.alias("c")).schema["c"].dataType
        key = _falling(o.column, kind) if o.descending else _micros(o.column, kind) if plain and isinstance(kind, T.TimestampType | T.TimestampNTZType) else o.column
        fields += [lead.alias(f"n{i}"), key.alias(f"o{i}")]
    return F.struct(*fields) if fields else F.struct(F.lit(0).alias("o"))


def _micros(c: Column, kind: T.DataType) -> Column:
    return F.unix_micros(c) if isinstance(kind, T.TimestampType) else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def _falling(c: Column, kind: T.DataType) -> Column:
    """A value that falls as ``c`` rises.

    Bytes of a text are complemented and closed with a digit above all others, so that a text falls below what begins it.
    """
    if isinstance(kind, T.BooleanType):
        return ~c
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return F.bitwise_not(c)  # unlike -c, right for the least number too
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.struct(~F.isnan(c), F.when(~F.isnan(c), -c))  # NaN is above all numbers
    if isinstance(kind, T.DecimalType):
        return -c
    if isinstance(kind, T.DateType):
        return -F.unix_date(c)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.bitwise_not(_micros(c, kind))
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    if isinstance(kind, T.NullType):
        return c
    raise ValueError(f"{kind.simpleString()} has no descending order here; order by its parts")
