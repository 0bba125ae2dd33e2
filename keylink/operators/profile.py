"""Column profiles, all derived from one table of value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Length that a NULL counts as when text lengths are averaged (the text "None").
NULL_TEXT_LENGTH = 4


def column_profile(counts: DataFrame) -> DataFrame:
    """Per ``cid``: rows, non-NULL rows, distinct values, groups, blanks.

    ``groups`` counts NULL as one value, ``distinct_values`` does not.  Where
    ``counts`` carries text statistics, ``ascii_rows`` and ``len_sum`` follow.
    """
    v, cnt = F.col("v"), F.col("cnt")
    present = v.isNotNull()

    def rows_where(condition):
        return F.coalesce(F.sum(F.when(condition, cnt)), F.lit(0))

    aggregates = [
        F.sum(cnt).alias("row_count"),
        rows_where(present).alias("non_null"),
        F.count(v).alias("distinct_values"),
        F.count(F.lit(1)).alias("groups"),
        rows_where(~present | (v == "")).alias("blanks"),
    ]
    if "ascii" in counts.columns:
        length = F.coalesce("chars", F.lit(NULL_TEXT_LENGTH))
        aggregates += [
            rows_where(present & F.col("ascii")).alias("ascii_rows"),
            F.sum(length.cast("bigint") * cnt).alias("len_sum"),
        ]
    return counts.groupBy("cid").agg(*aggregates)


def with_uniqueness(profile: DataFrame) -> DataFrame:
    """Adds ``is_unique``: complete and without duplicates."""
    return profile.withColumn(
        "is_unique",
        (F.col("non_null") == F.col("row_count"))
        & (F.col("distinct_values") == F.col("non_null")),
    )
