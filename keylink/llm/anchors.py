"""Anchors: for each window of n items, the first least-hashed run of k items within it.

Equal windows have their anchor at the same place, so whatever repeats shares an anchor, and about
2 / (n - k + 2) of all places are anchors. Positions in a document have POSITION_BITS bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keylink.functions.frames import fresh_name
from keylink.sources.workspace import Workspace

POSITION_BITS = 30
LEAST_ID = -(1 << 63)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of values[i:i + width] for every i that has so many."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def window_anchors(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The anchor of the window at each start; hashes are those of the runs of k at every place,
    width = n - k + 1. Ties go to the first place."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    order = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least(order, width)
    return (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def coordinate(key: Column, position: Column) -> Column:
    """One number that orders by document, then position. Rows of one id share coordinates."""
    doc = F.coalesce(key.cast("long"), F.lit(LEAST_ID)).cast("decimal(20,0)")
    return (doc * F.lit(1 << POSITION_BITS) + position).cast("decimal(38,0)")


def one_text_each(docs: DataFrame, key: str, text: str, space: Workspace) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells texts apart, as positions need it.

    That is ``key`` itself unless ids repeat. Then rows are numbered by id and hash of their text, so
    that rows of one id with different texts are documents of their own, and equal rows are one.
    """
    own = F.col(f"`{key}`").cast("long")
    if docs.groupBy(own.alias("_id")).agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty():
        return docs, key
    number, id_, digest = (fresh_name(n, docs.columns) for n in ("_number", "_id", "_digest"))
    told = docs.withColumns({id_: own, digest: F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))})
    order = space.save(
        told.select(F.col(id_).alias("_o"), F.col(digest).alias("_p")).distinct()
        .orderBy(F.asc_nulls_first("_o"), "_p")
        .withColumn("_q", F.monotonically_increasing_id()),
        "numbers",
    )
    # the columns of docs keep their names, which may be those of the numbers' table
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = told.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)],
        F.col(id_).alias("_i"), F.col(digest).alias("_d"),
    )
    same = F.col("_i").eqNullSafe(F.col("_o")) & (F.col("_d") == F.col("_p"))
    numbered = plain.join(order, same).select(
        *[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)], F.col("_q").alias(number)
    )
    return space.save(numbered, "numbered"), number


def union_length(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of size places lie in one of the spans."""
    depth = np.zeros(size + 1, dtype=np.int64)
    np.add.at(depth, starts, 1)
    np.subtract.at(depth, ends, 1)
    return np.cumsum(depth[:size]) > 0
