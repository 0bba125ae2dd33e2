"""Inclusion tests: how many rows of one column find their value in another.

All column pairs share one shuffle by value.  The rows of a value are at most
as many as there are candidate columns, because repeats were counted before.
Pairs are never emitted per value: each referencing row gets the *set* of keys
that hold its value, rows with the same set are summed, and only the few
distinct sets are spread out into pairs.

With many keys, as where hundreds of surrogate keys count from 1 and contain
each other, even that grows with the cube of their number: each column has as
many distinct sets as there are keys, each as long.  Then the sets are put in a
prefix tree, keys in most sets first, so that nested sets share one path.  A
key's hits are those of the subtrees below its nodes, summed by doubling the
distance to the ancestor that rows are passed to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keylink.functions.canonical import family, join_key, native_value
from keylink.functions.frames import fresh_name
from keylink.params import FIXED_RATIO_BASE
from keylink.sources.workspace import Workspace

# With fewer keys, spreading sets out is never dear.
MANY_KEYS = 64
# From this many rows of spread-out sets on, they meet in a prefix tree.
TREE_FROM_ROWS = 50_000_000


def hits_by_pair(
    rows: DataFrame, keys: int = 0, workspace: Workspace | None = None
) -> DataFrame:
    """``fk, pk, hits`` from rows ``v, cid, cnt, is_pk``.

    ``cnt`` is the number of rows of a referencing column holding ``v`` (NULL
    for a row that only states a key value).  A pair without a hit is absent.
    Given a ``workspace``, sets of many ``keys`` go through a prefix tree if
    spreading them out, column by column, would make too many rows.
    """
    keys_of_value = F.collect_set(F.when(F.col("is_pk"), F.col("cid"))).over(
        Window.partitionBy("v")
    )
    found = (
        rows.filter(F.col("v").isNotNull())
        .select("cid", "cnt", keys_of_value.alias("_keys"))
        .filter(F.col("cnt").isNotNull() & (F.size("_keys") > 0))
        .select(F.col("cid").alias("fk"), F.sort_array("_keys").alias("_keys"), "cnt")
    )
    if workspace is None or keys < MANY_KEYS:
        return hits_of_key_sets(found)
    per_set = workspace.save(sums_per_set(found), "sets")
    if (per_set.agg(F.sum(F.size("_keys"))).first()[0] or 0) < TREE_FROM_ROWS:
        return hits_of_key_sets(per_set.withColumnRenamed("_hits", "cnt"))
    return hits_by_tree(per_set, workspace)


def sums_per_set(found: DataFrame) -> DataFrame:
    return found.groupBy("fk", "_keys").agg(F.sum("cnt").alias("_hits"))


def hits_of_key_sets(found: DataFrame) -> DataFrame:
    """Sums ``fk, _keys, cnt`` per distinct key set, then per pair."""
    return (
        sums_per_set(found).select("fk", F.explode("_keys").alias("pk"), "_hits")
        .groupBy("fk", "pk")
        .agg(F.sum("_hits").alias("hits"))
    )


def hits_by_tree(per_set: DataFrame, workspace: Workspace) -> DataFrame:
    """Hits by pair from ``fk, _keys, _hits`` (see :func:`sums_per_set`, saved).

    There is one row per column and node of the prefix tree at most.  Only
    distinct sets are ever spread out into their keys, once and not per column.
    Nodes are known by the md5 of their path.
    """
    whole = F.md5(F.array_join(F.transform("_keys", lambda k: k.cast("string")), ","))
    per_set = per_set.withColumn("_set", whole)
    sets = per_set.groupBy("_set").agg(F.first("_keys").alias("_keys"))
    members = sets.select("_set", F.explode("_keys").alias("pk"))
    common = members.groupBy("pk").agg((-F.count(F.lit(1))).alias("_rank"))
    path = F.transform(F.sort_array(F.collect_list(F.struct("_rank", "pk"))), lambda e: e["pk"])
    node = F.transform(
        F.sequence(F.lit(1), F.size("_path")),
        lambda i: F.md5(F.array_join(F.slice("_text", F.lit(1), i), ",")),
    )
    paths = workspace.save(
        members.join(common, "pk").groupBy("_set").agg(path.alias("_path"))
        .withColumn("_text", F.transform("_path", lambda k: k.cast("string")))
        .select("_set", "_path", node.alias("_nodes")),
        "paths",
    )
    depth = paths.agg(F.max(F.size("_path"))).first()[0] or 0
    # Ancestors 1, 2, 4, ... steps up; none beyond the root.
    steps = [1 << i for i in range(max(depth - 1, 0).bit_length())]
    above = [F.get("_nodes", F.col("_at") - F.lit(step)) for step in steps]
    nodes = workspace.save(
        paths.select("_path", "_nodes", F.posexplode("_nodes").alias("_at", "_node"))
        .select(
            "_node", F.get("_path", F.col("_at")).alias("pk"),
            F.array(*above).cast("array<string>").alias("_above"),
        )
        .groupBy("_node").agg(F.first("pk").alias("pk"), F.first("_above").alias("_above")),
        "nodes",
    )
    ends = paths.select("_set", F.element_at("_nodes", -1).alias("_node"))
    sums = workspace.save(
        per_set.select("fk", "_set", F.col("_hits").alias("_sum")).join(ends, "_set")
        .select("fk", "_node", "_sum"),
        "sums",
    )
    for i in range(len(steps)):
        moved = (
            sums.join(nodes.select("_node", F.get("_above", F.lit(i)).alias("_up")), "_node")
            .filter(F.col("_up").isNotNull()).select("fk", F.col("_up").alias("_node"), "_sum")
        )
        before, sums = sums, workspace.save(
            sums.unionByName(moved).groupBy("fk", "_node").agg(F.sum("_sum").alias("_sum")), "sums"
        )
        workspace.drop(before)
    return (
        sums.join(nodes.select("_node", "pk"), "_node")
        .groupBy("fk", "pk").agg(F.sum("_sum").alias("hits"))
    )


def shared_rows(counts: DataFrame, fks: Sequence[int], pks: Sequence[int]) -> DataFrame:
    """Input of :func:`hits_by_pair` when both roles read the same counts."""
    cid = F.col("cid")
    return counts.filter(cid.isin(sorted({*fks, *pks}))).select(
        "v",
        "cid",
        F.when(cid.isin(list(fks)), F.col("cnt")).alias("cnt"),
        cid.isin(list(pks)).alias("is_pk"),
    )


def separate_rows(
    fk_counts: DataFrame, fks: Sequence[int], pk_counts: DataFrame, pks: Sequence[int]
) -> DataFrame:
    """Input of :func:`hits_by_pair` when the tested values are a sample.

    Key values that no tested value equals are dropped before the shuffle; how
    that semi join runs is left to Spark, which knows the size of the sample.
    """
    tested = fk_counts.filter(F.col("cid").isin(list(fks))).select("v", "cid", "cnt")
    keys = (
        pk_counts.filter(F.col("cid").isin(list(pks)))
        .select("v", "cid")
        .join(tested.select("v").distinct(), "v", "left_semi")
    )
    return tested.withColumn("is_pk", F.lit(False)).unionByName(
        keys.select(
            "v", "cid", F.lit(None).cast("bigint").alias("cnt"), F.lit(True).alias("is_pk")
        )
    )


def with_miss_ratio(hits: DataFrame, tested_rows: Column, ratio_base: str = "rows") -> DataFrame:
    """Adds ``misses`` and ``miss_ratio``; NULLs and repeats count row by row."""
    base = tested_rows if ratio_base == "rows" else F.lit(FIXED_RATIO_BASE)
    return hits.withColumn("misses", tested_rows - F.col("hits")).withColumn(
        "miss_ratio", F.col("misses") / base
    )


def accepted(pairs: DataFrame, sup_out_foreign_key: float) -> DataFrame:
    return pairs.filter(F.col("miss_ratio") <= F.lit(float(sup_out_foreign_key)))


def orphan_rows(fk_frame: DataFrame, fk: str, pk_frame: DataFrame, pk: str) -> DataFrame:
    """Rows of one table whose value is missing from one key column."""
    return _probe_one(fk_frame, fk, pk_frame, pk, "left_anti")


def matched_rows(fk_frame: DataFrame, fk: str, pk_frame: DataFrame, pk: str) -> DataFrame:
    """Rows of one table whose value occurs in one key column."""
    return _probe_one(fk_frame, fk, pk_frame, pk, "left_semi")


def _probe_one(fk_frame, fk, pk_frame, pk, how) -> DataFrame:
    fk_type, pk_type = fk_frame.schema[fk].dataType, pk_frame.schema[pk].dataType
    # Columns of one family are joined in their own type, others by their text.
    form = native_value if family(fk_type) == family(pk_type) else join_key
    # The key side is unique, so a hot value repeats on the left side only,
    # where the adaptive skew join can split it.
    name = fresh_name("_key", fk_frame.columns)
    keys = pk_frame.select(F.expr(form(pk, pk_type)).alias(name))
    return fk_frame.withColumn(name, F.expr(form(fk, fk_type))).join(keys, name, how).drop(name)
