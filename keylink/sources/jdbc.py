"""Databases read through Spark's JDBC source.

A dialect says how to reach a database, which policies fit it, and where its
catalog keeps names, types and comments.  The catalog views are read as plain
DataFrames and joined by Spark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylink.functions.canonical import INTEGRAL, family
from keylink.sources.catalog import Source, spark_catalog_source


@dataclass(frozen=True)
class Dialect:
    driver: str
    url: str
    type_policy: str
    class_policy: str
    quote: str
    tables: str
    columns: str
    max_connections: int | None = None

    def identifier(self, *parts: str) -> str:
        left, right = self.quote[0], self.quote[-1]
        return ".".join(left + part.replace(right, right * 2) + right for part in parts)


# Rows per round trip; results are streamed, never held whole in a task.
FETCH_ROWS = 10_000

_INFORMATION_SCHEMA = {
    "tables": "SELECT table_name, table_comment FROM information_schema.tables "
    "WHERE table_type = 'BASE TABLE' AND table_schema = {db}",
    "columns": "SELECT table_name, column_name, data_type AS type_name, column_comment "
    "FROM information_schema.columns WHERE table_schema = {db}",
}

# Drivers, address forms, catalog views and the policies that fit each database.
DIALECTS: dict[str, Dialect] = {
    "MYSQL": Dialect(
        "com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{db}?useCursorFetch=true",
        "mysql", "unique_only", "``", **_INFORMATION_SCHEMA,
    ),
    "GBASE": Dialect(
        "com.gbase.jdbc.Driver", "jdbc:gbase://{host}:{port}/{db}",
        "mysql", "unique_only", "``", **_INFORMATION_SCHEMA, max_connections=1,
    ),
    "ORACLE": Dialect(
        "oracle.jdbc.OracleDriver", "{url}",
        "oracle", "unique_only", '""',
        "SELECT table_name, comments AS table_comment FROM all_tab_comments "
        "WHERE table_type = 'TABLE' AND owner = {db}",
        "SELECT c.table_name, c.column_name, c.data_type AS type_name, "
        "m.comments AS column_comment FROM all_tab_columns c LEFT JOIN all_col_comments m "
        "ON m.owner = c.owner AND m.table_name = c.table_name "
        "AND m.column_name = c.column_name WHERE c.owner = {db}",
    ),
    "POSTGRESQL": Dialect(
        "org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{db}",
        "all", "ascii", '""',
        "SELECT c.relname AS table_name, obj_description(c.oid, 'pg_class') AS table_comment "
        "FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace "
        "WHERE n.nspname = 'public' AND c.relkind IN ('r', 'p')",
        "SELECT c.relname AS table_name, a.attname AS column_name, "
        "format_type(a.atttypid, NULL) AS type_name, "
        "col_description(c.oid, a.attnum) AS column_comment FROM pg_attribute a "
        "JOIN pg_class c ON c.oid = a.attrelid JOIN pg_namespace n ON n.oid = c.relnamespace "
        "WHERE n.nspname = 'public' AND c.relkind IN ('r', 'p') "
        "AND a.attnum > 0 AND NOT a.attisdropped",
    ),
    "SQLSERVER": Dialect(
        "com.microsoft.sqlserver.jdbc.SQLServerDriver",
        "jdbc:sqlserver://{host}:{port};databaseName={db}",
        "mysql", "any", "[]",
        "SELECT t.name AS table_name, CAST(p.value AS NVARCHAR(4000)) AS table_comment "
        "FROM sys.tables t LEFT JOIN sys.extended_properties p ON p.major_id = t.object_id "
        "AND p.minor_id = 0 AND p.name = 'MS_Description'",
        "SELECT t.name AS table_name, c.name AS column_name, y.name AS type_name, "
        "CAST(p.value AS NVARCHAR(4000)) AS column_comment FROM sys.tables t "
        "JOIN sys.columns c ON c.object_id = t.object_id "
        "JOIN sys.types y ON y.user_type_id = c.user_type_id "
        "LEFT JOIN sys.extended_properties p ON p.major_id = t.object_id "
        "AND p.minor_id = c.column_id AND p.name = 'MS_Description'",
    ),
}
HIVE = "HIVE"
HIVE_POLICIES = ("all", "ascii")


def policies(source_type: str) -> tuple[str, str]:
    """(type policy, class policy) that go with a kind of database."""
    kind = source_type.upper()
    if kind == HIVE:
        return HIVE_POLICIES
    dialect = dialect_of(kind)
    return dialect.type_policy, dialect.class_policy


def dialect_of(source_type: str) -> Dialect:
    try:
        return DIALECTS[source_type.upper()]
    except KeyError:
        raise ValueError(
            f"unsupported database type {source_type!r}; known: {[*DIALECTS, HIVE]}"
        ) from None


@dataclass(frozen=True)
class Connection:
    source_type: str
    db: str
    host: str = ""
    port: int | str = ""
    user: str = ""
    password: str = ""
    url: str = ""

    def options(self) -> dict[str, str]:
        dialect = dialect_of(self.source_type)
        address = dialect.url.format(host=self.host, port=self.port, db=self.db, url=self.url)
        return {
            "url": address,
            "driver": dialect.driver,
            "user": self.user,
            "password": self.password,
            "fetchsize": str(FETCH_ROWS),
        }

    def metadata_query(self, which: str) -> str:
        literal = "'" + self.db.replace("'", "''") + "'"
        return getattr(dialect_of(self.source_type), which).replace("{db}", literal)

    def table_name(self, table: str) -> str:
        dialect = dialect_of(self.source_type)
        schema = {"POSTGRESQL": "public", "SQLSERVER": "dbo"}.get(
            self.source_type.upper(), self.db
        )
        return dialect.identifier(schema, table)


def database_source(
    spark: SparkSession,
    connection: Connection,
    names: Sequence[str] | None = None,
    partitions: int = 1,
) -> Source:
    """All base tables of a database (or the named ones), read lazily."""
    if connection.source_type.upper() == HIVE:
        return spark_catalog_source(spark, connection.db, names)
    listed = read_query(spark, connection, connection.metadata_query("tables")).collect()
    comments = {row["table_name"]: row["table_comment"] or "" for row in listed}
    wanted = [n for n in (names or sorted(comments)) if n in comments]
    described = read_query(spark, connection, connection.metadata_query("columns")).filter(
        F.col("table_name").isin(wanted)
    )
    rows = described.collect()
    return Source(
        db=connection.db,
        tables={name: read_table(spark, connection, name, partitions) for name in wanted},
        table_comments=comments,
        column_comments={
            (r["table_name"], r["column_name"]): r["column_comment"] or "" for r in rows
        },
        declared_types={(r["table_name"], r["column_name"]): r["type_name"] for r in rows},
    )


def read_query(spark: SparkSession, connection: Connection, query: str) -> DataFrame:
    frame = spark.read.format("jdbc").options(**connection.options(), query=query).load()
    # Databases differ in the case they give to unquoted names.
    return frame.toDF(*[name.lower() for name in frame.columns])


def read_table(
    spark: SparkSession, connection: Connection, table: str, partitions: int = 1
) -> DataFrame:
    """One table; split over its first integer column when asked for."""
    name = connection.table_name(table)
    options = {**connection.options(), "dbtable": name}
    whole = spark.read.format("jdbc").options(**options).load()
    limit = dialect_of(connection.source_type).max_connections or partitions
    split = split_options(whole, min(partitions, limit))
    if not split:
        return whole
    column = dialect_of(connection.source_type).identifier(split["partitionColumn"])
    low, high = read_query(
        spark, connection, f"SELECT min({column}) AS low, max({column}) AS high FROM {name}"
    ).first()
    if low is None:
        return whole
    bounds = {"lowerBound": str(low), "upperBound": str(high)}
    return spark.read.format("jdbc").options(**options, **split, **bounds).load()


def split_options(frame: DataFrame, partitions: int) -> Mapping[str, str]:
    integers = [f.name for f in frame.schema.fields if family(f.dataType) == INTEGRAL]
    if partitions <= 1 or not integers:
        return {}
    return {"partitionColumn": integers[0], "numPartitions": str(partitions)}
