"""Which profiled columns may be keys, and which may point at keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_pk(policy: str = "any") -> Column:
    """Complete and unique; under ``ascii`` a text key must be all-ASCII too."""
    unique = (F.col("non_null") == F.col("row_count")) & (
        F.col("distinct_values") == F.col("non_null")
    )
    if policy == "ascii":
        return unique & (~F.col("is_text") | (F.col("ascii_rows") == F.col("distinct_values")))
    return unique


def is_fk(policy: str = "any", both_roles: bool = True) -> Column:
    """Columns whose values may be drawn from a key elsewhere.

    ``any``: every column.  ``unique_only``: keys alone.  ``ascii``: keys, and
    complete text columns with repeats whose rows are all ASCII.
    """
    key = is_pk(policy)
    as_key = key & F.lit(both_roles)
    if policy == "any":
        return as_key | ~key
    if policy == "unique_only":
        return as_key
    repeats = (
        F.col("is_text")
        & (F.col("non_null") == F.col("row_count"))
        & (F.col("ascii_rows") == F.col("non_null"))
        & (F.col("distinct_values") < F.col("non_null"))
    )
    return as_key | repeats


def classify(profile: DataFrame, policy: str = "any", both_roles: bool = True) -> DataFrame:
    """Adds ``pk`` and ``fk`` to a profile that carries ``is_text``."""
    return profile.withColumn("pk", is_pk(policy)).withColumn("fk", is_fk(policy, both_roles))


def candidate_pairs(fk_columns: DataFrame, pk_columns: DataFrame) -> DataFrame:
    """Every candidate pair across two different tables.

    Both inputs are catalog rows, one per column.  The discovery plans do not
    enumerate pairs; they call this only for columns that a tolerance lets
    through without a single matching value.
    """
    fk = fk_columns.select(
        F.col("cid").alias("fk"), F.col("table_name").alias("fk_table"),
        F.col("column_name").alias("fk_column"),
    )
    pk = pk_columns.select(
        F.col("cid").alias("pk"), F.col("table_name").alias("pk_table"),
        F.col("column_name").alias("pk_column"),
    )
    return fk.join(pk, F.col("fk_table") != F.col("pk_table"))
