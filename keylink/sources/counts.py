"""Value counts kept between runs, file by file.

The first refresh counts the values of every file of a table; later ones count new and changed
files alone.  Counts of files that are gone stay in the store but are no longer read, so that a
current count is the sum over the current files, exact and without a scan of the source.

A load writes its counts first and its manifest rows last; counts without a manifest row are never
read, and of two loads that counted the same file at the same time one is used.  Tables that aren't
read from files (see :func:`from_files`) can't be kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylink.functions.frames import metadata_frame, union_all
from keylink.operators.values import SLOTS, value_counts
from keylink.sources.catalog import ColumnInfo, Source

FILES_SCHEMA = "table_name string, fid bigint, path string, size bigint, modified bigint, counted string"
MANIFEST_SCHEMA = f"{FILES_SCHEMA}, load string"
COUNTS_SCHEMA = (
    "fid bigint, column_name string, v string, cnt bigint, slot bigint, chars int, ascii boolean, "
    "table_name string, load string"
)
_KEY = [field.split(" ")[0] for field in FILES_SCHEMA.split(", ")]
_FILE = "xxhash64(_metadata.file_path)"


@dataclass(frozen=True)
class Refresh:
    """Files of a table: counted now, already known, and known but gone."""

    table: str
    added: int
    kept: int
    gone: int


class CountStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # else nothing was written yet
                raise
            return metadata_frame(self.spark, [], schema)

    def _files(self, source: Source, columns: Sequence[ColumnInfo]) -> DataFrame:
        """The current files of the tables of ``columns`` (FILES_SCHEMA); reads no column."""
        frames = []
        for table, items in _by_table(columns).items():
            # A file that was counted for other columns counts as another one.
            counted = F.md5(F.lit("|".join(sorted(f"{c.name}:{c.dtype.simpleString()}" for c in items))))
            found = source.tables[table].selectExpr(
                f"{_FILE} AS fid", "_metadata.file_path AS path", "_metadata.file_size AS size",
                "unix_micros(_metadata.file_modification_time) AS modified",
            ).distinct()
            frames.append(found.select(F.lit(table).alias("table_name"), "*", counted.alias("counted")))
        return union_all(frames)

    def refresh(self, source: Source, columns: Sequence[ColumnInfo]) -> list[Refresh]:
        """Counts what is new in the files of ``columns``; afterwards the store is current."""
        outside = [t for t in _by_table(columns) if not from_files(source.tables[t])]
        if outside:
            raise ValueError(f"tables that are not read from files: {', '.join(outside)}")
        now = self._files(source, columns)
        manifest = self._read("manifest", MANIFEST_SCHEMA)
        stale = [tuple(row) for row in now.join(manifest, _KEY, "left_anti").select(*_KEY).collect()]
        known = {
            row["table_name"]: row
            for row in manifest.join(now, _KEY, "left_semi").groupBy("table_name")
            .agg(F.countDistinct("fid").alias("kept")).collect()
        }
        ever = {
            row["table_name"]: row["n"]
            for row in manifest.join(now.withColumn("_now", F.lit(True)), _KEY, "left")
            .filter(F.col("_now").isNull()).groupBy("table_name")
            .agg(F.countDistinct("path").alias("n")).collect()
        }
        added: dict[str, list[tuple]] = {}
        for row in stale:
            added.setdefault(row[0], []).append(row)
        if len({(row[0], row[1]) for row in stale}) < len(stale):
            raise ValueError("two files share a hash of their paths")
        if added:
            self._load(source, [c for c in columns if c.table in added], added)
        return [
            Refresh(
                table, len(added.get(table, ())),
                known[table]["kept"] if table in known else 0, ever.get(table, 0),
            )
            for table in _by_table(columns)
        ]

    def _load(self, source: Source, columns: Sequence[ColumnInfo], added: dict[str, list]) -> None:
        load = uuid.uuid4().hex
        # Spark prunes the files of a scan by this column.
        tables = {
            table: source.tables[table].filter(F.col("_metadata.file_path").isin([r[2] for r in rows]))
            for table, rows in added.items()
        }
        counted = value_counts(
            replace(source, tables={**source.tables, **tables}), columns,
            text_stats=True, slots=(0, SLOTS), apart={"fid": _FILE},
        )
        names = metadata_frame(
            self.spark, [(c.cid, c.table, c.name) for c in columns],
            "cid int, table_name string, column_name string",
        )
        counts = counted.join(F.broadcast(names), "cid").select(
            "fid", "column_name", "v", "cnt", F.col("slot").cast("bigint"), F.col("chars").cast("int"),
            "ascii", "table_name", F.lit(load).alias("load"),
        )
        counts.write.mode("append").partitionBy("table_name", "load").parquet(f"{self.root}/counts")
        # The manifest comes last: counts without an entry are never read.
        rows = [(*row, load) for rows in added.values() for row in rows]
        metadata_frame(self.spark, rows, MANIFEST_SCHEMA).write.mode("append").parquet(
            f"{self.root}/manifest"
        )

    def counts(
        self, source: Source, columns: Sequence[ColumnInfo], slots: tuple[int, int] | None = None
    ) -> DataFrame:
        """``cid, v, cnt, slot, chars, ascii`` of the current files, as refreshed before.

        Only counts are read and shuffled.  A column without rows has no row.
        """
        manifest = self._read("manifest", MANIFEST_SCHEMA)
        now = manifest.join(self._files(source, columns), _KEY, "left_semi")
        current = now.groupBy("table_name", "fid").agg(F.min("load").alias("load"))
        names = metadata_frame(
            self.spark, [(c.cid, c.table, c.name) for c in columns],
            "cid int, table_name string, column_name string",
        )
        stored = self._read("counts", COUNTS_SCHEMA)
        if slots is not None:
            stored = stored.filter(F.col("slot").between(slots[0], slots[1] - 1))
        return (
            stored.join(current, ["table_name", "load", "fid"], "left_semi")
            .join(F.broadcast(names), ["table_name", "column_name"])
            .groupBy("cid", "v")
            .agg(
                F.sum("cnt").alias("cnt"), F.max("slot").alias("slot"), F.max("chars").alias("chars"),
                F.max("ascii").alias("ascii"),
            )
        )


def _by_table(columns: Sequence[ColumnInfo]) -> dict[str, list[ColumnInfo]]:
    grouped: dict[str, list[ColumnInfo]] = {}
    for c in columns:
        grouped.setdefault(c.table, []).append(c)
    return grouped


def from_files(frame: DataFrame) -> bool:
    """Whether Spark knows the file of each row of ``frame``."""
    try:
        frame.select("_metadata.file_path")
    except AnalysisException:
        return False
    return True
