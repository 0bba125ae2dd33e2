"""When each relation was there: intervals of runs, and the relations as of a run.

``valid_from`` is the run that found a relation, ``valid_to`` the first run after it that didn't;
a relation that is still there has none.  One that vanished and came back has several intervals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keylink.functions.frames import metadata_frame
from keylink.operators.results import KEY_IN_MODEL

HISTORY_COLUMNS = (*KEY_IN_MODEL, "valid_from", "valid_to")


def relation_history(found: DataFrame, runs: Sequence[int]) -> DataFrame:
    """Intervals from the relations of many runs (``run`` beside the key) in the order ``runs``.

    One shuffle by relation, however many runs there are.
    """
    spark = found.sparkSession
    following = dict(zip(runs, runs[1:], strict=False))
    order = metadata_frame(
        spark, [(run, place, following.get(run)) for place, run in enumerate(runs)],
        "run int, _place int, _next int",
    )
    placed = found.select(*KEY_IN_MODEL, "run").distinct().join(F.broadcast(order), "run")
    by_relation = Window.partitionBy(*KEY_IN_MODEL).orderBy("_place")
    # In an unbroken stretch, place and rank grow together.
    stretch = placed.withColumn("_stretch", F.col("_place") - F.row_number().over(by_relation))
    return (
        stretch.groupBy(*KEY_IN_MODEL, "_stretch")
        .agg(
            F.min_by("run", "_place").alias("valid_from"),
            F.max_by("_next", "_place").alias("valid_to"),
        )
        .select(*HISTORY_COLUMNS)
    )


def extend_history(history: DataFrame, current: DataFrame, run: int) -> DataFrame:
    """The history after one more run, from the intervals that are still open."""
    now = current.select(*KEY_IN_MODEL).distinct().withColumn("_now", F.lit(True))
    open_ = history.filter(F.col("valid_to").isNull()).drop("valid_to")
    met = open_.join(now, list(KEY_IN_MODEL), "full").select(
        *KEY_IN_MODEL,
        F.coalesce("valid_from", F.lit(run)).alias("valid_from"),
        F.when(F.col("_now").isNull(), F.lit(run)).alias("valid_to"),
    )
    return history.filter(F.col("valid_to").isNotNull()).select(*HISTORY_COLUMNS).unionByName(met)


def as_of(history: DataFrame, run: int) -> DataFrame:
    """Intervals that hold a run; runs are numbered in rising order."""
    return history.filter(
        (F.col("valid_from") <= run) & (F.col("valid_to").isNull() | (F.col("valid_to") > run))
    )


def returned(history: DataFrame) -> DataFrame:
    """Relations that vanished and came back, with the number of their intervals."""
    return history.groupBy(*KEY_IN_MODEL).agg(F.count(F.lit(1)).alias("intervals")).filter(
        "intervals > 1"
    )
