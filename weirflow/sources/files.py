"""Files with declared or found structure."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Patterns of the type inference, and its types in the order in which they are tried.
PATTERNS = {"INTEGER": r"^[+-]?[0-9]{1,18}$", "DECIMAL": r"^[+-]?([0-9]{1,18}|[0-9]+\.[0-9]+)$", "TIMESTAMP": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}", "DATE": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "BOOLEAN": r"^(?i)(true|false)$"}
CASTS = {"INTEGER": "bigint", "DECIMAL": "decimal(38,6)", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "BOOLEAN": "boolean", "STRING": "string"}
DELIMITERS = {".tsv": "\t", ".tab": "\t", ".psv": "|"}


def clean_names(names: Sequence[str]) -> list[str]:
    """Upper-case identifiers; repeated ones are numbered from _2."""
    out: list[str] = []
    for name in names:
        n = re.sub(r"\W+", "_", str(name).strip()).strip("_") or "col"
        n = ("c_" + n if n[0].isdigit() else n).upper()
        k, m = 2, n
        while m in out:
            m, k = f"{n}_{k}", k + 1
        out.append(m)
    return out


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """The first type that all non-blank values of a column have; one pass over all rows, STRING for blank columns."""
    columns = list(columns or df.columns)
    tests = []
    for i, c in enumerate(columns):
        v = F.trim(F.col(f"`{c}`").cast("string"))
        some = v.isNotNull() & (v != "")
        tests.append(F.count_if(some).alias(f"n{i}"))
        tests += [F.count_if(some & ~v.rlike(p)).alias(f"{t}{i}") for t, p in PATTERNS.items()]
    row = df.agg(*tests).first()
    return {c: next((t for t in PATTERNS if row[f"n{i}"] and not row[f"{t}{i}"]), "STRING") for i, c in enumerate(columns)}


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns as their types; blank is null, and so is what does not fit."""
    return df.select(*[(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).try_cast(CASTS[types[c]]) if types.get(c, "STRING") != "STRING" else F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, infer: bool = True, line_breaks: bool | None = None) -> DataFrame:
    """CSV, TSV or text with a header; the delimiter by the suffix, or a tab if the first line has one and no comma.

    Byte order marks and blank lines are skipped, short rows are filled with null. ``line_breaks``: whether quoted values can hold some; a file is then one task, else Spark
    splits it. By default a pass over the lines tells: only a record that goes on in the next line has a line with an odd number of quotes.
    """
    if delimiter is None:
        delimiter = next((d for s, d in DELIMITERS.items() if path.lower().endswith(s)), None)
    if delimiter is None:
        first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
        delimiter = "\t" if first and "\t" in first[0][0] and "," not in first[0][0] else ","
    if line_breaks is None:
        line_breaks = not spark.read.text(path).where("(length(value) - length(replace(value, '\"', ''))) % 2 = 1").isEmpty()
    df = spark.read.csv(path, header=True, sep=delimiter, mode="PERMISSIVE", inferSchema=False, enforceSchema=False, quote='"', escape='"', multiLine=line_breaks)
    df = df.toDF(*clean_names([c.lstrip("﻿") for c in df.columns])).dropna(how="all")
    return typed(df, infer_types(df)) if infer else df


def read_json_records(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """JSON lines, an array of records, or an object that holds them in ``data`` or ``rows``; keys sorted, values as text, nested ones as JSON."""
    df = spark.read.json(path, multiLine=True, primitivesAsString=True)
    for wrapper in ("data", "rows"):
        if df.columns == [wrapper] and df.schema[wrapper].dataType.typeName() == "array":
            df = df.select(F.explode(wrapper).alias("r")).select("r.*")
            break
    names = sorted(df.columns)
    flat = df.select(*[(F.to_json(f"`{c}`") if df.schema[c].dataType.typeName() in ("struct", "array", "map") else F.col(f"`{c}`").cast("string")).alias(c) for c in names])
    flat = flat.toDF(*clean_names(names))
    return typed(flat, infer_types(flat)) if infer else flat


def read_manifest_table(spark: SparkSession, entry: dict, folder: str, target: DataFrame | None = None) -> DataFrame:
    """A table of a manifest: name, format, columns (name -> type), incremental_column. Only what is newer than the target, if it is given."""
    from weirflow.functions.types import canonical, spark_type
    from weirflow.operators.rows import newer_than

    reader = spark.read.format(entry.get("format", "parquet"))
    df = reader.load(f"{folder}/{entry['name']}.{entry.get('format', 'parquet')}")
    if entry.get("columns"):
        df = df.select(*[F.col(c).cast(spark_type(canonical(t))).alias(c) for c, t in entry["columns"].items()])
    return newer_than(df, entry["incremental_column"], target) if entry.get("incremental_column") else df


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: object, high: object, parts: int, **options: str) -> DataFrame:
    """A database table in parallel by ranges of a column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: str, **options: str) -> DataFrame:
    """A topic of JSON values as a stream: the parsed fields, with key, topic and timestamp of the broker."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic}, **options).load()
    return raw.select(F.col("key").cast("string").alias("message_key"), "topic", F.col("timestamp").alias("message_time"), F.from_json(F.col("value").cast("string"), schema).alias("v")).select("message_key", "topic", "message_time", "v.*")


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, n_rows, n_nulls, longest (characters), digits (of integers before the point) and whether it could be a watermark; one pass."""
    columns = list(columns or df.columns)
    rows: list[Column] = []
    for c in columns:
        text = F.col(c).cast("string")
        temporal = df.schema[c].dataType.typeName() in ("date", "timestamp", "timestamp_ntz")
        named = re.search(r"(updated|modified|changed|created|load|last|_ts$|_dt$|date|time)", c, re.I) is not None
        rows.append(F.struct(F.lit(c).alias("column_name"), F.count("*").alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_nulls"), F.max(F.length(text)).alias("longest"), F.max(F.length(F.regexp_extract(text, r"^[+-]?([0-9]+)", 1))).alias("digits"), F.lit(temporal).alias("temporal"), F.lit(temporal and named).alias("watermark")))
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
