"""A database as seen by the engine: named tables plus their metadata.

A :class:`Source` holds lazy DataFrames only.  Its catalog frames carry one row
per table or column, so they are metadata-sized whatever the tables hold.
"""

from __future__ import annotations

import logging

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keylink.functions.canonical import declared_name, family, is_text, quoted
from keylink.functions.frames import metadata_frame, union_all

log = logging.getLogger(__name__)

TABLES_SCHEMA = T.StructType(
    [
        T.StructField("db", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("table_comment", T.StringType()),
    ]
)
COLUMNS_SCHEMA = T.StructType(
    [
        T.StructField("cid", T.IntegerType()),
        T.StructField("db", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("type_name", T.StringType()),
        T.StructField("type_class", T.StringType()),
        T.StructField("is_text", T.BooleanType()),
        T.StructField("column_comment", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class ColumnInfo:
    cid: int
    table: str
    name: str
    dtype: T.DataType
    type_name: str
    comment: str
    ordinal: int


@dataclass(frozen=True)
class Source:
    """Tables of one database, in a fixed order.

    ``declared_types`` overrides the Spark type name of a column where the
    source declares something finer (``VARCHAR2`` of a remote database).
    ``unreadable`` names tables that were asked for but could not be opened.
    ``stored`` has the frame and the path of tables that are plain Parquet files.
    """

    db: str
    tables: Mapping[str, DataFrame]
    table_comments: Mapping[str, str] = field(default_factory=dict)
    column_comments: Mapping[tuple[str, str], str] = field(default_factory=dict)
    declared_types: Mapping[tuple[str, str], str] = field(default_factory=dict)
    unreadable: tuple[str, ...] = ()
    stored: Mapping[str, tuple[DataFrame, str]] = field(default_factory=dict)

    def parquet_path(self, table: str) -> str | None:
        """Where the rows of a table lie, as long as the table is all of them."""
        frame, path = self.stored.get(table, (None, None))
        return path if frame is not None and self.tables.get(table) is frame else None

    def subset(self, names: Iterable[str]) -> Source:
        wanted = set(names)
        return replace(
            self,
            tables={name: frame for name, frame in self.tables.items() if name in wanted},
            unreadable=tuple(name for name in self.unreadable if name in wanted),
        )

    def unknown(self, names: Iterable[str]) -> list[str]:
        return [name for name in names if name not in self.tables]

    def columns(self) -> list[ColumnInfo]:
        """All columns; ``cid`` numbers them across the whole source."""
        found: list[ColumnInfo] = []
        for table, frame in self.tables.items():
            for ordinal, item in enumerate(frame.schema.fields):
                place = (table, item.name)
                comment = self.column_comments.get(place) or item.metadata.get("comment")
                found.append(
                    ColumnInfo(
                        cid=len(found),
                        table=table,
                        name=item.name,
                        dtype=item.dataType,
                        type_name=self.declared_types.get(place) or declared_name(item.dataType),
                        comment=comment or "",
                        ordinal=ordinal,
                    )
                )
        return found

    def tables_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.db, name, self.table_comments.get(name) or "") for name in self.tables]
        return metadata_frame(spark, rows, TABLES_SCHEMA)

    def columns_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (
                c.cid,
                self.db,
                c.table,
                c.name,
                c.type_name,
                (family(c.dtype) or "other").split("(")[0],
                is_text(c.dtype),
                c.comment,
                c.ordinal,
            )
            for c in self.columns()
        ]
        return metadata_frame(spark, rows, COLUMNS_SCHEMA)


def select_tables(catalog: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested names against the catalog; unknown names stay, marked."""
    return requested.join(catalog, "table_name", "left").select(
        "table_name",
        F.col("db").isNotNull().alias("found"),
        F.coalesce("table_comment", F.lit("")).alias("table_comment"),
    )


def comment_from_ddl(ddl: DataFrame, text_column: str = "ddl") -> DataFrame:
    """Adds ``table_comment``, cut out of the text of a CREATE TABLE statement."""
    # Fixed value: what stands between ") COMMENT" and the last white space of its line.
    pattern = r"\)\sCOMMENT(.*)\s"
    return ddl.withColumn(
        "table_comment",
        F.coalesce(F.trim(F.regexp_extract(text_column, pattern, 1)), F.lit("")),
    )


def attach_comments(columns: DataFrame, comments: DataFrame) -> DataFrame:
    """Left join of raw (binary UTF-8) comments; a missing comment becomes ''."""
    text = comments.select(
        "table_name",
        "column_name",
        F.decode("raw_comment", "UTF-8").alias("_comment"),
    )
    return (
        columns.join(text, ["table_name", "column_name"], "left")
        .withColumn("column_comment", F.coalesce("_comment", F.lit("")))
        .drop("_comment")
    )


def table_row_counts(source: Source) -> DataFrame:
    """``table_name, row_count`` in one job; reads no column of any table.

    An unreadable table has no row count.
    """
    spark = next(iter(source.tables.values())).sparkSession
    known = metadata_frame(spark, enumerate(source.tables), "tid int, table_name string")
    closed = metadata_frame(
        spark, [(name,) for name in source.unreadable], "table_name string"
    ).withColumn("row_count", F.lit(None).cast("bigint"))
    ones = union_all(
        [frame.selectExpr(f"{tid} AS tid") for tid, frame in enumerate(source.tables.values())]
    )
    counted = ones.groupBy("tid").agg(F.count(F.lit(1)).alias("row_count"))
    found = known.join(counted, "tid", "left").select(
        "table_name", F.coalesce("row_count", F.lit(0)).alias("row_count")
    )
    return found.unionByName(closed) if source.unreadable else found


def column_counts(source: Source, columns: Sequence[ColumnInfo] | None = None) -> DataFrame:
    """``cid, row_count, non_null`` with one scan per table and no data shuffle."""
    by_table: dict[str, list[ColumnInfo]] = {}
    for item in source.columns() if columns is None else columns:
        by_table.setdefault(item.table, []).append(item)
    counts = []
    for table, items in by_table.items():
        totals = source.tables[table].selectExpr(
            "count(1) AS row_count",
            *[f"count({quoted(c.name)}) AS n{c.cid}" for c in items],
        )
        cells = ", ".join(f"{c.cid}, n{c.cid}" for c in items)
        counts.append(
            totals.selectExpr("row_count", f"stack({len(items)}, {cells}) AS (cid, non_null)")
        )
    return union_all(counts).select("cid", "row_count", "non_null")


def files_source(
    spark: SparkSession,
    path: str,
    names: Sequence[str] | None = None,
    fmt: str = "parquet",
    db: str = "files",
    options: Mapping[str, str] | None = None,
    **metadata,
) -> Source:
    """Tables stored as ``<path>/<name>.<fmt>`` (a file or a directory each)."""
    if names is None:
        names = list_file_tables(spark, path, fmt)

    def load(name: str) -> DataFrame:
        reader = spark.read.format(fmt).options(**(options or {}))
        return reader.load(f"{path}/{name}.{fmt}")

    tables, unreadable = open_tables(names, load)
    plain = tables if fmt == "parquet" and not options else {}
    stored = {name: (frame, f"{path}/{name}.{fmt}") for name, frame in plain.items()}
    return Source(db=db, tables=tables, unreadable=unreadable, stored=stored, **metadata)


def open_tables(
    names: Sequence[str], load: Callable[[str], DataFrame]
) -> tuple[dict[str, DataFrame], tuple[str, ...]]:
    """Opens tables side by side (a schema is a small job of its own).

    Tables that are missing or closed to the user are reported, not fatal.
    """

    def attempt(name: str) -> DataFrame | None:
        try:
            return load(name)
        except AnalysisException as error:
            log.warning("table %s cannot be opened: %s", name, error.getCondition())
            return None

    with ThreadPoolExecutor(max_workers=8) as pool:
        opened = dict(zip(names, pool.map(attempt, names), strict=True))
    tables = {name: frame for name, frame in opened.items() if frame is not None}
    return tables, tuple(name for name in names if name not in tables)


def list_file_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> list[str]:
    """Names of the tables at ``path``: its files and folders called ``<name>.<fmt>``, however deep
    their own files lie. Only this one level is listed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(n.removesuffix(f".{fmt}") for n in names if n.endswith(f".{fmt}") and n != f".{fmt}")


def spark_catalog_source(
    spark: SparkSession, database: str, names: Sequence[str] | None = None
) -> Source:
    """Tables of the session catalog, Hive tables among them; views are left out."""
    described = {
        t.name: t.description or ""
        for t in spark.catalog.listTables(database)
        if t.tableType != "VIEW" and not t.isTemporary
    }
    wanted = [n for n in (names or sorted(described)) if n in described]
    tables, unreadable = open_tables(
        wanted, lambda name: spark.table(f"{quoted(database)}.{quoted(name)}")
    )
    return Source(database, tables, table_comments=described, unreadable=unreadable)
