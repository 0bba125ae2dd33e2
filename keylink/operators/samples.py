"""Repeatable samples of many tables at once.

A sample has the rows with the lowest md5 over their integers and texts, as in ``column_sample``.
The rows below a cut that a few more than the wanted ones are expected to pass are written by one
job for all tables, as texts of the columns asked for.  A second job finds the hash of the last
wanted row of each table, from counts by hash; rows up to it are the sample.  What is kept of a
table is about as large as its sample, and nothing is ranked row by row in one task.

A table whose copies (rows of one hash) leave too few rows below the cut, or straddle the last
place, isn't settled and goes through ``column_sample``, which orders copies by their other columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keylink.functions.canonical import join_key, quoted
from keylink.functions.frames import md5_of, metadata_frame, union_all
from keylink.operators.values import sample_key_columns
from keylink.sources.catalog import ColumnInfo, Source
from keylink.sources.workspace import Workspace


@dataclass(frozen=True)
class Samples:
    """``counts`` (``cid, v, cnt``) of the settled tables' samples, and the tables left over."""

    counts: DataFrame | None
    unsettled: tuple[str, ...]


def expected_cut(rows: int, total: int) -> str:
    """Hex digits below which a little more than ``rows`` of ``total`` hashes lie; g is above all."""
    share = (rows + 6 * rows**0.5 + 50) / max(total, 1)
    return f"{int(2**32 * share):08x}" if share < 1 else "g"


def sampled_counts(
    source: Source,
    columns: Sequence[ColumnInfo],
    hashed: Mapping[str, Sequence[str]],
    rows: int,
    table_rows: Mapping[str, int],
    workspace: Workspace,
) -> Samples:
    """Value counts of ``columns`` in samples of ``rows`` rows.

    ``hashed`` names the columns of each table that take part in its sample order.
    """
    spark = next(iter(source.tables.values())).sparkSession
    by_table: dict[str, list[ColumnInfo]] = {}
    for c in columns:
        by_table.setdefault(c.table, []).append(c)
    parts, places = [], []
    tables = list(by_table)
    for tid, table in enumerate(tables):
        frame = source.tables[table].select(*[quoted(name) for name in hashed[table]])
        names = sample_key_columns(frame) or frame.columns
        cells = F.array(*[F.expr(join_key(c.name, c.dtype)) for c in by_table[table]])
        cut = expected_cut(rows, table_rows[table])
        parts.append(
            source.tables[table]
            .select(
                F.lit(tid).alias("tid"), md5_of([F.col(quoted(n)) for n in names]).alias("h"),
                cells.alias("cells"),
            )
            .filter(F.col("h") < cut)
        )
        places += [(tid, place, c.cid) for place, c in enumerate(by_table[table])]
    low = workspace.save(union_all(parts), "sample")
    running = F.sum("_n").over(Window.partitionBy("tid").orderBy("h"))
    by_hash = low.groupBy("tid", "h").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", running)
    found = {
        row["tid"]: row
        for row in by_hash.groupBy("tid").agg(
            F.max("_upto").alias("all"),
            F.min(F.when(F.col("_upto") >= rows, F.struct("_upto", "h"))).alias("last"),
        ).collect()
    }
    limits, unsettled = [], []
    for tid, table in enumerate(tables):
        row, whole = found.get(tid), table_rows[table] <= rows
        if whole:
            limits.append((tid, "g"))
        elif row is not None and row["last"] is not None and row["last"]["_upto"] == rows:
            limits.append((tid, row["last"]["h"]))
        else:
            unsettled.append(table)
    if not limits:
        return Samples(None, tuple(unsettled))
    chosen = low.join(F.broadcast(metadata_frame(spark, limits, "tid int, _last string")), "tid")
    cells = chosen.filter(F.col("h") <= F.col("_last")).select(
        "tid", F.posexplode("cells").alias("place", "v")
    )
    named = metadata_frame(spark, places, "tid int, place int, cid int")
    counts = (
        cells.groupBy("tid", "place", "v").agg(F.count(F.lit(1)).alias("cnt"))
        .join(F.broadcast(named), ["tid", "place"]).select("cid", "v", "cnt")
    )
    return Samples(counts, tuple(unsettled))
