"""Tables of databases over JDBC: what they declare, parallel reads with bounds found, and loads that are counted.

A read is cut by ranges of one column: the one that is named, or a single-column primary key of whole numbers, dates or times. Its least and greatest value come from the database, and predicates and columns
are pushed down to it by Spark. A load goes to a staging table first, in parallel; only if that holds as many rows as passed, one statement puts them into the target, so a task that ran
twice or not at all changes nothing there. Types that databases leave open (a NUMBER without digits, text types of their own) are read as ``functions.types`` has them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.types import canonical, spark_type

#: Class and address of each dialect's public driver; the jar is the caller's to add.
DRIVERS = {
    "snowflake": ("net.snowflake.client.jdbc.SnowflakeDriver", "jdbc:snowflake://{host}/?db={database}"),
    "databricks": ("com.databricks.client.jdbc.Driver", "jdbc:databricks://{host}:{port}/{database}"),
    "redshift": ("com.amazon.redshift.jdbc42.Driver", "jdbc:redshift://{host}:{port}/{database}"),
    "synapse": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://{host}:{port};database={database}"),
    "sqlserver": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc:sqlserver://{host}:{port};database={database}"),
    "oracle": ("oracle.jdbc.OracleDriver", "jdbc:oracle:thin:@//{host}:{port}/{database}"),
    "postgres": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{database}"),
    "teradata": ("com.teradata.jdbc.TeraDriver", "jdbc:teradata://{host}/DATABASE={database}"),
    "db2": ("com.ibm.db2.jcc.DB2Driver", "jdbc:db2://{host}:{port}/{database}"),
    "hana": ("com.sap.db.jdbc.Driver", "jdbc:sap://{host}:{port}/?databaseName={database}"),
    "derby": ("org.apache.derby.jdbc.EmbeddedDriver", "jdbc:derby:memory:{database}"),
}
#: Types by which a read can be cut.
CUTS = ("TINYINT", "SMALLINT", "INTEGER", "INT", "BIGINT", "NUMBER", "NUMERIC", "DECIMAL", "DATE", "TIMESTAMP")


@dataclass(frozen=True)
class Database:
    spark: SparkSession
    dialect: str
    url: str
    options: dict[str, str] = field(default_factory=dict)

    @classmethod
    def at(cls, spark: SparkSession, dialect: str, database: str, host: str = "", port: int | str = "", **options: str) -> Database:
        return cls(spark, dialect, DRIVERS[dialect][1].format(host=host, port=port, database=database), options)

    def reader(self, **more: object):
        return self.spark.read.format("jdbc").options(driver=DRIVERS[self.dialect][0], url=self.url, **self.options, **{k: str(v) for k, v in more.items()})

    @contextmanager
    def connection(self):
        """A connection of the driver's JVM, for questions about the catalogue and single statements."""
        jvm = self.spark.sparkContext._jvm
        jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(DRIVERS[self.dialect][0]).getDeclaredConstructor(None).newInstance(None)
        given = jvm.java.util.Properties()
        for k, v in self.options.items():
            given.setProperty(k, v)
        c = jvm.java.sql.DriverManager.getConnection(self.url, given)
        try:
            yield c
        except BaseException:
            if not c.getAutoCommit():
                c.rollback()
            raise
        finally:
            c.close()

    def run(self, *statements: str) -> None:
        with self.connection() as c:
            s = c.createStatement()
            for x in statements:
                s.execute(x)
            s.close()


def _listed(rows: object, *names: str) -> list[tuple]:
    out = []
    while rows.next():
        out.append(tuple(rows.getString(n) for n in names))
    rows.close()
    return out


@dataclass(frozen=True)
class Declared:
    """What a catalogue says of a table: (name, type, length or digits, scale, nullable) of each column; the primary key; unique sets; (column, table, column) of each reference."""

    columns: list[tuple[str, str, int, int, bool]]
    key: list[str]
    unique: list[list[str]]
    references: list[tuple[str, str, str]]


def declared(db: Database, table: str, schema: str | None = None) -> Declared:
    """Columns, keys and references as the database declares them."""
    with db.connection() as c:
        m = c.getMetaData()
        cols = [(n, t.split("(")[0].strip().upper(), int(s or 0), int(d or 0), nullable == "YES") for n, t, s, d, nullable in _listed(m.getColumns(None, schema, table, None), "COLUMN_NAME", "TYPE_NAME", "COLUMN_SIZE", "DECIMAL_DIGITS", "IS_NULLABLE")]
        key = [n for n, _ in sorted(_listed(m.getPrimaryKeys(None, schema, table), "COLUMN_NAME", "KEY_SEQ"), key=lambda r: int(r[1]))]
        index: dict[str, list[str]] = {}
        for name, column in _listed(m.getIndexInfo(None, schema, table, True, False), "INDEX_NAME", "COLUMN_NAME"):
            if name is not None:
                index.setdefault(name, []).append(column)
        refs = _listed(m.getImportedKeys(None, schema, table), "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME")
    return Declared(cols, key, sorted(index.values()), sorted(refs))


def sizes(db: Database, tables: Sequence[str]) -> DataFrame:
    """table_name and n_rows, one question each."""
    out = [(t, int(db.reader(query=f"SELECT COUNT(*) AS n FROM {t}").load().first()[0])) for t in tables]
    return db.spark.createDataFrame(out, "table_name string, n_rows long")


def read_table(db: Database, table: str, column: str | None = None, parts: int | None = None, rows_a_part: int = 500_000, schema: str | None = None) -> DataFrame:
    """A table in parallel by ranges of ``column``, whose bounds the database gives; rows with a null there come with the first range. Without such a column or rows it is one task."""
    about = declared(db, table, schema)
    kinds = {c[0].upper(): c[1] for c in about.columns}
    name = f"{schema}.{table}" if schema else table
    if column is None and len(about.key) == 1 and kinds.get(about.key[0].upper()) in CUTS:
        column = about.key[0]
    if column is not None and kinds.get(column.upper()) not in CUTS:
        raise ValueError(f"{column} of {name} is no number, date or time")
    # a number without digits is read as the canonical type has it, not as a guess of the driver
    loose = {n: spark_type(canonical(t, db.dialect)) for n, t, size, scale, _ in about.columns if t in ("NUMBER", "NUMERIC") and not size}
    more = {"customSchema": ", ".join(f"{n} {t}" for n, t in loose.items())} if loose else {}
    if column is None:
        return db.reader(dbtable=name, **more).load()
    low, high, n = db.reader(query=f"SELECT MIN({column}) AS low, MAX({column}) AS high, COUNT(*) AS n FROM {name}").load().first()
    if low is None or low == high:
        return db.reader(dbtable=name, **more).load()
    return db.reader(dbtable=name, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts or max(1, -(-int(n) // rows_a_part)), **more).load()


class Miscounted(Exception):
    """A load whose staging table does not hold what passed; the target is as it was."""


def load_table(df: DataFrame, db: Database, table: str, parts: int = 8, batch: int = 10_000, replace: bool = False, schema: str | None = None) -> int:
    """Adds the rows of ``df`` to a table that is there (``replace``: instead of its rows) and returns how many; one transaction moves them from the staging table."""
    name, stage = (f"{schema}." if schema else "") + table, f"stage_{uuid.uuid4().hex[:12]}"
    columns = [c[0] for c in declared(db, table, schema).columns]
    by = {c.upper(): c for c in df.columns}
    if missing := [c for c in by if c not in {x.upper() for x in columns}]:
        raise ValueError(f"{name} has no column {', '.join(sorted(missing))}")
    held = [c for c in columns if c.upper() in by]
    seen = Observation()
    rows = df.select(*[F.col(f"`{by[c.upper()]}`").alias(c) for c in held]).observe(seen, F.count(F.lit(1)).alias("n"))
    list_ = ", ".join(held)
    try:
        rows.coalesce(parts).write.format("jdbc").options(driver=DRIVERS[db.dialect][0], url=db.url, dbtable=stage, batchsize=str(batch), **db.options).mode("append").save()
        passed = seen.get["n"]
        staged = int(db.reader(query=f"SELECT COUNT(*) AS n FROM {stage}").load().first()[0])
        if staged != passed:
            raise Miscounted(f"{passed} rows passed, {staged} are in {stage}")
        with db.connection() as c:
            c.setAutoCommit(False)
            s = c.createStatement()
            if replace:
                s.execute(f"DELETE FROM {name}")
            quoted = ", ".join(f'"{h}"' for h in held)
            s.execute(f"INSERT INTO {name} ({list_}) SELECT {quoted} FROM {stage}")
            c.commit()
            s.close()
        return passed
    finally:
        with db.connection() as c:
            if _listed(c.getMetaData().getTables(None, None, stage.upper(), None), "TABLE_NAME") or _listed(c.getMetaData().getTables(None, None, stage, None), "TABLE_NAME"):
                s = c.createStatement()
                s.execute(f"DROP TABLE {stage}")
                s.close()
