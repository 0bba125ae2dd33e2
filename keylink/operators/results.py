"""Comparing and replacing stored relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keylink.functions.frames import md5_of

# A relation is the same as an earlier one when all of these agree.
RELATION_KEY = ("db1", "table1", "column1", "db2", "table2", "column2")
KEY_IN_MODEL = ("model", *RELATION_KEY)
AUTOMATIC, BY_USER = 0, 1

RESULT_COLUMNS = (
    "id", "model", "db1", "table1", "table1_comment", "column1", "column1_comment",
    "db2", "table2", "table2_comment", "column2", "column2_comment",
    "status", "scantype", "create_time", "edit_time", "matching_degree",
)


def result_rows(relations: DataFrame, now: Column) -> DataFrame:
    """Discovered relations in stored form, with an id that never changes."""
    renamed = relations.withColumnRenamed("model1", "model")
    for end in ("table1", "column1", "table2", "column2"):
        renamed = renamed.withColumnRenamed(f"{end}comment", f"{end}_comment")
    return (
        renamed.withColumn("id", md5_of([F.col(name) for name in KEY_IN_MODEL]))
        .withColumn("status", F.lit(1))
        .withColumn("scantype", F.lit(AUTOMATIC))
        .withColumn("create_time", now)
        .withColumn("edit_time", now)
        .select(*RESULT_COLUMNS)
    )


def relation_status(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Sets ``status``: 0 where the previous run knew the relation, else 1."""
    known = previous.select(*KEY_IN_MODEL).distinct().withColumn("_known", F.lit(True))
    return (
        current.join(known, list(KEY_IN_MODEL), "left")
        .withColumn("status", F.when(F.col("_known"), 0).otherwise(1))
        .drop("_known")
    )


def new_relations(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.join(previous.select(*KEY_IN_MODEL), list(KEY_IN_MODEL), "left_anti")


def removed_relations(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Automatic rows of the previous run that were not found again."""
    return previous.filter(F.col("scantype") == AUTOMATIC).join(
        current.select(*KEY_IN_MODEL), list(KEY_IN_MODEL), "left_anti"
    )


def replace_relations(stored: DataFrame, current: DataFrame, models: DataFrame) -> DataFrame:
    """What the store holds after a run of ``models``.

    Their automatic rows go, rows a user made or edited stay, and a new row
    gives way to a user's row of the same relation.  Other models are untouched.
    """
    rerun = models.select("model").distinct().withColumn("_rerun", F.lit(True))
    kept = (
        stored.join(rerun, "model", "left")
        .filter(F.col("_rerun").isNull() | (F.col("scantype") != AUTOMATIC))
        .drop("_rerun")
    )
    fresh = current.join(kept.select(*KEY_IN_MODEL), list(KEY_IN_MODEL), "left_anti")
    return kept.unionByName(fresh)


def run_summary(results: DataFrame) -> DataFrame:
    """Per model: how many relations, how many of them new."""
    return results.groupBy("model").agg(
        F.count(F.lit(1)).alias("relation_num"),
        F.sum(F.col("status").cast("bigint")).alias("new_relation_num"),
    )
