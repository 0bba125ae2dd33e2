"""Row counts, NULLs, least and greatest values out of Parquet footers, without reading a page.

Spark answers such aggregates from the footers where it reads Parquet through its newer source and
all of them can be pushed down.  Both are settings of a session, so the questions are put in a
session of their own beside the caller's.  Files whose footers lack a statistic, and tables that
aren't plain Parquet files, are counted by a scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keylink.functions.canonical import INTEGRAL, family, quoted
from keylink.functions.frames import metadata_frame, union_all
from keylink.sources.catalog import ColumnInfo, Source, column_counts

SCHEMA = "cid int, row_count bigint, non_null bigint, low_int bigint, high_int bigint"


def footer_session(spark: SparkSession) -> SparkSession:
    """A session on the same cluster that answers counts and ranges from footers."""
    other = spark.newSession()
    kept = [x for x in other.conf.get("spark.sql.sources.useV1SourceList").split(",") if x.strip() != "parquet"]
    other.conf.set("spark.sql.sources.useV1SourceList", ",".join(kept))
    other.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return other


def footer_query(session: SparkSession, path: str, columns: Sequence[ColumnInfo]) -> DataFrame:
    """One row: rows, then non-NULL rows and, of integers, least and greatest by column."""
    aggregates = ["count(1) AS rows"]
    for c in columns:
        aggregates.append(f"count({quoted(c.name)}) AS n{c.cid}")
        if family(c.dtype) == INTEGRAL:
            aggregates += [f"min({quoted(c.name)}) AS l{c.cid}", f"max({quoted(c.name)}) AS h{c.cid}"]
    return session.read.parquet(path).selectExpr(*aggregates)


def _pushed(frame: DataFrame) -> bool:
    return "PushedAggregation: [COUNT(*)" in frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def from_footers(
    spark: SparkSession, source: Source, columns: Sequence[ColumnInfo]
) -> tuple[list[tuple], list[ColumnInfo]]:
    """Rows of SCHEMA as footers tell them, and the columns that have to be scanned."""
    by_table: dict[str, list[ColumnInfo]] = {}
    for c in columns:
        by_table.setdefault(c.table, []).append(c)
    session = footer_session(spark)

    def ask(table: str) -> list[tuple] | None:
        items, path = by_table[table], source.parquet_path(table)
        if path is None or any(not isinstance(c.dtype, T.AtomicType) for c in items):
            return None
        try:
            question = footer_query(session, path, items)
            if not _pushed(question):
                return None
            row = question.first()
        except (PySparkException, Py4JError):  # a file without statistics
            return None
        ends = lambda c: (
            (row[f"l{c.cid}"], row[f"h{c.cid}"]) if family(c.dtype) == INTEGRAL else (None, None)
        )
        # Without any file there is no count to add up.
        return [(c.cid, row["rows"] or 0, row[f"n{c.cid}"] or 0, *ends(c)) for c in items]

    with ThreadPoolExecutor(max_workers=8) as pool:
        answers = dict(zip(by_table, pool.map(ask, by_table), strict=True))
    found = [row for rows in answers.values() if rows for row in rows]
    return found, [c for table, rows in answers.items() if rows is None for c in by_table[table]]


def counts_and_ranges(spark: SparkSession, source: Source, columns: Sequence[ColumnInfo]) -> DataFrame:
    """``cid, row_count, non_null, low_int, high_int``; the last two of integers alone."""
    found, rest = from_footers(spark, source, columns)
    frames = [metadata_frame(spark, found, SCHEMA)]
    if rest:
        ranges = []
        for c in rest:
            if family(c.dtype) == INTEGRAL:
                ranges.append(
                    source.tables[c.table].selectExpr(
                        f"{c.cid} AS cid", f"CAST(min({quoted(c.name)}) AS BIGINT) AS low_int",
                        f"CAST(max({quoted(c.name)}) AS BIGINT) AS high_int",
                    )
                )
        counted = column_counts(source, rest)
        none = metadata_frame(spark, [], "cid int, low_int bigint, high_int bigint")
        frames.append(
            counted.join(union_all([none, *ranges]), "cid", "left").select(
                "cid", "row_count", "non_null", "low_int", "high_int"
            )
        )
    return union_all(frames)


def no_key(row) -> bool:
    """NULLs, or fewer integers between least and greatest than rows: the column can't be unique."""
    _, rows, present, low, high = row
    return present < rows or (low is not None and high - low + 1 < rows)
