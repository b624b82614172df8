"""Canonical types, what Spark calls them, and whether a column fits one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The canonical types.
SPARK = {
    "STRING": "string", "FIXED_STRING": "char({length})", "INTEGER": "int", "BIG_INTEGER": "bigint", "DECIMAL": "decimal({precision},{scale})", "FLOAT": "double", "BOOLEAN": "boolean", "DATE": "date", "TIME": "string",
    "TIMESTAMP": "timestamp_ntz", "TIMESTAMP_TZ": "timestamp", "BINARY": "binary", "JSON": "string", "VARIANT": "variant", "ARRAY": "array<string>", "MAP": "map<string,string>", "STRUCT": "struct<>", "GEOGRAPHY": "string",
}
NAMES = {
    "VARCHAR": "STRING", "VARCHAR2": "STRING", "NVARCHAR": "STRING", "TEXT": "STRING", "CLOB": "STRING", "XML": "STRING", "CHAR": "FIXED_STRING", "NCHAR": "FIXED_STRING", "INT": "INTEGER", "SMALLINT": "INTEGER", "TINYINT": "INTEGER", "BYTEINT": "INTEGER",
    "BIGINT": "BIG_INTEGER", "NUMBER": "DECIMAL", "NUMERIC": "DECIMAL", "MONEY": "DECIMAL", "DOUBLE": "FLOAT", "REAL": "FLOAT", "FLOAT8": "FLOAT", "BIT": "BOOLEAN", "BOOL": "BOOLEAN", "DATETIME": "TIMESTAMP", "DATETIME2": "TIMESTAMP", "TIMESTAMP_NTZ": "TIMESTAMP",
    "TIMESTAMPTZ": "TIMESTAMP_TZ", "TIMESTAMP_LTZ": "TIMESTAMP_TZ", "DATETIMEOFFSET": "TIMESTAMP_TZ", "BLOB": "BINARY", "VARBINARY": "BINARY", "BYTES": "BINARY", "RAW": "BINARY", "OBJECT": "VARIANT", "UUID": "STRING", "GEOMETRY": "GEOGRAPHY",
}
DECIMAL = (38, 6)


@dataclass(frozen=True)
class Canonical:
    name: str
    length: int | None = None
    precision: int | None = None
    scale: int | None = None


def canonical(declared: str, dialect: str = "") -> Canonical:
    """VARCHAR2(30) -> STRING of length 30; an unknown name is a STRING. A date of the oracle dialect has a time."""
    name, _, rest = declared.strip().upper().partition("(")
    numbers = [int(x) for x in rest.rstrip(") ").split(",") if x.strip().lstrip("-").isdigit()]
    name = name.strip()
    kind = name if name in SPARK else NAMES.get(name, "STRING")
    if kind == "DATE" and dialect == "oracle":
        kind = "TIMESTAMP"
    if kind == "DECIMAL":
        return Canonical(kind, precision=numbers[0] if numbers else DECIMAL[0], scale=numbers[1] if len(numbers) > 1 else 0 if numbers else DECIMAL[1])
    return Canonical(kind, length=numbers[0] if numbers and kind in ("STRING", "FIXED_STRING", "BINARY") else None)


def spark_type(t: Canonical) -> str:
    if t.name == "FIXED_STRING" and t.length is None:
        return "string"
    return SPARK[t.name].format(length=t.length, precision=t.precision or DECIMAL[0], scale=DECIMAL[1] if t.scale is None else t.scale)


def check_fit(source: T.StructType, target: dict[str, Canonical]) -> list[tuple[str, str]]:
    """(column, warning) for what a load can lose: precision_loss, scale_loss, timezone_change, unsupported_type, implicit_conversion, unknown_column."""
    out = []
    for name, t in target.items():
        if name not in source.names:
            out.append((name, "unknown_column"))
            continue
        s = source[name].dataType
        if t.name in ("TIME", "GEOGRAPHY"):
            out.append((name, "unsupported_type"))
        if t.name == "DECIMAL" and isinstance(s, T.DecimalType):
            if s.scale > (t.scale or 0):
                out.append((name, "scale_loss"))
            if s.precision - s.scale > (t.precision or 38) - (t.scale or 0):
                out.append((name, "precision_loss"))
        elif t.name == "INTEGER" and isinstance(s, T.LongType | T.DecimalType | T.DoubleType):
            out.append((name, "precision_loss"))
        elif {t.name, s.typeName()} in ({"TIMESTAMP", "timestamp"}, {"TIMESTAMP_TZ", "timestamp_ntz"}):
            out.append((name, "timezone_change"))
        elif t.name in SPARK and s.simpleString() != spark_type(t) and not (t.name == "FIXED_STRING" and s.typeName() == "string"):
            out.append((name, "implicit_conversion"))
    return out


def create_table(name: str, schema: T.StructType, using: str = "parquet", partition_by: tuple[str, ...] = (), comment: str | None = None) -> str:
    """CREATE TABLE for a schema: names quoted, NOT NULL and comments of the fields kept."""
    quoted = lambda x: ".".join("`" + p.replace("`", "``") + "`" for p in x.split("."))
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    fields = []
    for f in schema:
        field = f"{quoted(f.name) if '.' not in f.name else '`' + f.name + '`'} {f.dataType.simpleString().upper()}"
        field += "" if f.nullable else " NOT NULL"
        fields.append(field + (f" COMMENT {text(f.metadata['comment'])}" if "comment" in f.metadata else ""))
    out = f"CREATE TABLE {quoted(name)} ({', '.join(fields)}) USING {using}"
    if partition_by:
        out += f" PARTITIONED BY ({', '.join('`' + c.replace('`', '``') + '`' for c in partition_by)})"
    return out + (f" COMMENT {text(comment)}" if comment else "")
