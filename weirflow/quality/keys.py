"""Keys and references of tables, found from their rows: exact, and without comparing column with column.

Keys: sets of columns without nulls whose values together never repeat, and that hold no smaller such set. Sets are looked at by size; a set above a key is not looked at, nor is one whose values
repeat in a bounded sample of rows, or among one in ``SLICES`` of its values, already (what repeats there repeats). One shuffle of (set, hash of the values) a size counts the rest; where a hash repeats, its values are compared.

References: a column whose values all are values of a key column. Every value goes out once with the bits of the columns it was seen in, over all tables; bits of equal values are united, and a column's values
lie in another column if every value with the one's bit has the other's: the united bits of all of its values, and-ed. One shuffle for all columns, whatever their number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 10_000
#: Parts by value of which one is looked at before all.
SLICES = 64
#: Bits of a word.
WORD = 62


def key_columns(df: DataFrame) -> list[str]:
    """Columns whose values can be compared: no maps and variants."""
    return [f.name for f in df.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]


def _repeats(df: DataFrame, sets: Sequence[tuple[str, ...]]) -> set[tuple[str, ...]]:
    """Those of the sets whose values repeat, nulls being equal; sets of one size."""
    size = len(sets[0])
    one = [F.struct(F.lit(i).alias("s"), F.array(*[F.to_json(F.struct(F.col(f"`{c}`").alias("x"))) for c in s]).alias("v")) for i, s in enumerate(sets)]
    rows = df.select(F.explode(F.array(*one)).alias("e")).select("e.s", *[F.col("e.v")[k].alias(f"v{k}") for k in range(size)])
    counted = rows.groupBy("s", *[f"v{k}" for k in range(size)]).agg(F.count("*").alias("n")).groupBy("s").agg(F.max("n").alias("n"))
    return {sets[r["s"]] for r in counted.where("n > 1").collect()}  # a row for each set


def _repeats_by_hash(df: DataFrame, sets: Sequence[tuple[str, ...]], slices: int) -> set[tuple[str, ...]]:
    """Those of the sets whose values repeat, nulls being equal; of the rows of ``slices`` parts by value, which hold equal rows together, only one is looked at."""
    text = lambda c: F.to_json(F.struct(F.col(f"`{c}`").alias("x")))
    plain = {f.name for f in df.schema if isinstance(f.dataType, T.IntegralType | T.FractionalType | T.StringType | T.DateType | T.TimestampType)}
    # a hash first: values that repeat have one that repeats
    one = [F.struct(F.lit(i).alias("s"), F.xxhash64(*[F.col(f"`{c}`") if c in plain else text(c) for c in s]).alias("h")) for i, s in enumerate(sets)]
    rows = df.select(F.inline(F.array(*one)))
    if slices > 1:
        rows = rows.where(F.pmod("h", F.lit(slices)) == 0)
    twice = rows.groupBy("s", "h").agg(F.count("*").alias("n")).where("n > 1")
    some = {r["s"]: r["h"] for r in twice.groupBy("s").agg(F.min_by("h", F.struct(-F.col("n"), "h")).alias("h")).collect()}  # a row for each set
    out = set()
    for i, h in some.items():
        own = df.where(one[i]["h"] == F.lit(h)).select(*[text(c).alias(f"v{k}") for k, c in enumerate(sets[i])])
        if not own.groupBy(*own.columns).count().where("count > 1").isEmpty():
            out.add(sets[i])
        elif slices == 1:  # that hash stands for several values: all are compared
            every = df.select(*[text(c).alias(f"v{k}") for k, c in enumerate(sets[i])])
            if not every.groupBy(*every.columns).count().where("count > 1").isEmpty():
                out.add(sets[i])
    return out


def keys(df: DataFrame, largest: int = 2, columns: Sequence[str] | None = None, sample: int = SAMPLE) -> list[tuple[str, ...]]:
    """The minimal unique sets of at most ``largest`` columns, smaller ones first, in the order of the columns. A table without rows has none."""
    columns = list(columns or key_columns(df))
    counts = df.agg(F.count("*"), *[F.count_if(F.col(f"`{c}`").isNull()) for c in columns]).first()
    if not counts[0]:
        return []
    whole = [c for c, n in zip(columns, counts[1:], strict=True) if n == 0]
    some = df.select(*[F.col(f"`{c}`") for c in whole]).limit(sample).cache() if whole else df
    found: list[tuple[str, ...]] = []
    try:
        for size in range(1, largest + 1):
            sets = [s for s in combinations(whole, size) if not any(set(k) <= set(s) for k in found)]
            for slices in (0, SLICES, 1):
                if sets:
                    bad = _repeats_by_hash(df, sets, slices) if slices else _repeats(some, sets)
                    sets = [s for s in sets if s not in bad]
            found += sets
    finally:
        if whole:
            some.unpersist()
    return found


def _kind(t: T.DataType) -> str | None:
    """Types whose values can be equal; numbers with a fraction, texts that are long by nature and nested ones make no references."""
    if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "whole"
    return {T.StringType: "text", T.DateType: "date", T.BinaryType: "binary"}.get(type(t))


def included(tables: Mapping[str, DataFrame], columns: Sequence[tuple[str, str]] | None = None) -> dict[tuple[str, str], set[tuple[str, str]]]:
    """For each (table, column) that has values: the other columns that hold all of its values. Nulls are left out."""
    own = list(columns or [(t, f.name) for t, df in tables.items() for f in df.schema if _kind(f.dataType)])
    if not own:
        return {}
    words = -(-len(own) // WORD)
    bit = {c: divmod(i, WORD) for i, c in enumerate(own)}

    def bits(c: tuple[str, str]) -> Column:
        w, b = bit[c]
        return F.array(*[F.lit(1 << b if k == w else 0).cast("long") for k in range(words)])

    parts = []
    for t, df in tables.items():
        mine = [c for c in own if c[0] == t]
        if mine:
            each = [F.struct(F.lit(_kind(df.schema[c].dataType)).alias("k"), F.col(f"`{c}`").cast("string").alias("v"), bits((t, c)).alias("m")) for _, c in mine]
            rows = df.select(F.explode(F.array(*each)).alias("e")).select("e.*").where("v is not null")
            parts.append(rows.groupBy("k", "v").agg(*[F.bit_or(F.col("m")[w]).alias(f"m{w}") for w in range(words)]))
    values = reduce(DataFrame.unionByName, parts).groupBy("k", "v").agg(*[F.bit_or(f"m{w}").alias(f"m{w}") for w in range(words)])
    wanted = []
    for i, c in enumerate(own):
        w, b = bit[c]
        has = F.col(f"m{w}").bitwiseAND(F.lit(1 << b)) != 0
        wanted += [F.bit_and(F.when(has, F.col(f"m{v}"))).alias(f"c{i}_{v}") for v in range(words)]
    row = values.agg(*wanted).first()
    out = {}
    for i, c in enumerate(own):
        if row[f"c{i}_0"] is not None:
            out[c] = {d for d in own if d != c and row[f"c{i}_{bit[d][0]}"] >> bit[d][1] & 1}
    return out


def references(tables: Mapping[str, DataFrame], columns: Sequence[tuple[str, str]] | None = None) -> list[tuple[str, str, str, str]]:
    """(table, column, key's table, key column) wherever all values of a column are values of another table's single-column key."""
    single = {(t, k[0]) for t, df in tables.items() for k in keys(df, 1)}
    return sorted((*c, *d) for c, held in included(tables, columns).items() for d in held if d in single and d[0] != c[0])
