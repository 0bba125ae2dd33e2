"""Gates that decide which tables and columns take part."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keylink.functions.frames import metadata_frame
from keylink.params import MAX_BLANK_RATIO, TYPE_POLICIES

GLOBAL_SCOPE = "_"
_RULES_SCHEMA = T.StructType(
    [
        T.StructField("scope", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("rule", T.StringType()),
    ]
)


def table_gate(
    counts: DataFrame, inf_tab_len: int = 0, max_rows: int | None = None
) -> DataFrame:
    """Adds ``reason``: ``ok``, ``too_long``, ``empty`` or ``too_short``.

    A table that cannot be read (``row_count`` NULL) is ``unreadable``.
    """
    rows = F.col("row_count")
    reason = F.when(rows.isNull(), "unreadable")
    if max_rows is not None:
        reason = reason.when(rows > max_rows, "too_long")
    reason = reason.when(rows == 0, "empty").when(rows < inf_tab_len, "too_short")
    return counts.withColumn("reason", reason.otherwise("ok"))


def rules_frame(spark: SparkSession, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [
        (scope, position, rule)
        for scope, listed in rules.items()
        for position, rule in enumerate(listed)
    ]
    return metadata_frame(spark, rows, _RULES_SCHEMA)


def _matches(name: Column, rule: Column) -> Column:
    """A rule ending in % names one column; any other rule is a prefix."""
    exact = rule.endswith("%")
    return F.when(exact, name == F.expr("left(rule, length(rule) - 1)")).otherwise(
        name.startswith(rule)
    )


def column_name_gate(
    spark: SparkSession,
    columns: DataFrame,
    rules: Mapping[str, Sequence[str]],
    mode: str = "documented",
) -> DataFrame:
    """Adds ``name_kept`` to a frame with ``table_name, column_name``.

    ``documented``: a column goes when a global rule or a rule of its table
    matches it.  ``compat``: of the global rules only the first counts, a
    global %-rule keeps just the column it names, and an empty global list
    drops everything; table rules are as documented.
    """
    if not rules:
        return columns.withColumn("name_kept", F.lit(True))
    name = F.col("column_name")
    global_rules = list(rules.get(GLOBAL_SCOPE, ()))
    if mode == "documented":
        kept = ~reduce(
            lambda done, rule: done | _literal_match(name, rule), global_rules, F.lit(False)
        )
    elif GLOBAL_SCOPE not in rules:
        kept = F.lit(True)
    elif not global_rules:
        kept = F.lit(False)
    else:
        first = global_rules[0]
        matched = _literal_match(name, first)
        kept = matched if first.endswith("%") else ~matched
    if not any(listed for scope, listed in rules.items() if scope != GLOBAL_SCOPE):
        return columns.withColumn("name_kept", kept)
    table_rules = rules_frame(spark, rules).filter(F.col("scope") != GLOBAL_SCOPE)
    hit_by_table_rule = columns.join(
        table_rules,
        (F.col("table_name") == F.col("scope")) & _matches(name, F.col("rule")),
        "left_semi",
    ).select("table_name", "column_name", F.lit(True).alias("_table_hit"))
    return (
        columns.join(hit_by_table_rule, ["table_name", "column_name"], "left")
        .withColumn("name_kept", kept & F.col("_table_hit").isNull())
        .drop("_table_hit")
    )


def _literal_match(name: Column, rule: str) -> Column:
    return name == rule[:-1] if rule.endswith("%") else name.startswith(rule)


def column_type_gate(columns: DataFrame, policy: str = "all") -> DataFrame:
    """Adds ``type_kept``: the declared type is on the list of the policy."""
    allowed = TYPE_POLICIES[policy]
    possible = F.col("type_class") != "other"
    if allowed is None:
        return columns.withColumn("type_kept", possible)
    return columns.withColumn(
        "type_kept", possible & F.upper("type_name").isin(list(allowed))
    )


def role_bars(columns: DataFrame, barred_tables: Sequence[str]) -> DataFrame:
    """Columns of tables that may play the role in question."""
    if not barred_tables:
        return columns
    return columns.filter(~F.col("table_name").isin(list(barred_tables)))


def complete_columns(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("non_null") == F.col("row_count"))


def too_short_text(inf_str_len: float) -> Column:
    """Average text length below the bound; needs ``len_sum, row_count``."""
    return F.col("len_sum") / F.col("row_count") < F.lit(inf_str_len)


def too_few_distinct(inf_dup_ratio: float) -> Column:
    """Fewer distinct values (NULL is one) than the ratio asks for."""
    return F.col("groups") < F.col("row_count") * F.lit(inf_dup_ratio)


def too_blank(max_blank_ratio: float = MAX_BLANK_RATIO) -> Column:
    return F.col("blanks") / F.col("row_count") > F.lit(max_blank_ratio)


def value_gate(
    profile: DataFrame,
    use_str_len: bool = False,
    inf_str_len: float = 0,
    inf_dup_ratio: float = 0.0,
    max_blank_ratio: float = MAX_BLANK_RATIO,
) -> DataFrame:
    """Adds ``reject_reason`` (NULL = passed); the first failing gate names it."""
    reason = F.when(F.coalesce("row_count", F.lit(0)) == 0, "no_rows")
    if use_str_len:
        reason = reason.when(too_short_text(inf_str_len), "avg_len")
    reason = reason.when(too_few_distinct(inf_dup_ratio), "distinct_ratio").when(
        too_blank(max_blank_ratio), "blank_ratio"
    )
    return profile.withColumn("reject_reason", reason)
