"""Small helpers for building DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def metadata_frame(
    spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType | str
) -> DataFrame:
    """Catalog-sized rows as a local relation (no Python worker at run time)."""
    rows = list(rows)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(schema)
    columns = [
        pa.array([row[i] for row in rows], type=field.type)
        for i, field in enumerate(arrow_schema)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow_schema), schema)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, paired up so that the plan stays shallow."""
    level = list(frames)
    while len(level) > 1:
        level = [
            level[i].unionByName(level[i + 1]) if i + 1 < len(level) else level[i]
            for i in range(0, len(level), 2)
        ]
    return level[0]


def fresh_name(name: str, columns: Sequence[str]) -> str:
    """``name``, lengthened until no column bears it in any case."""
    taken = {column.lower() for column in columns}
    while name.lower() in taken:
        name += "_"
    return name


def md5_of(columns: Sequence[Column], separator: str = "|") -> Column:
    """md5 over several columns; a NULL is told apart from an empty text."""
    parts = [F.coalesce(column.cast("string"), F.lit("\\N")) for column in columns]
    return F.md5(F.concat_ws(separator, *parts))
