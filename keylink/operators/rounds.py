"""Inclusion in rounds over slices of the value space, with an early exit for pairs and columns.

Each round counts the values of some slots (parts of the space of values by hash) in the referring
columns that are still in question, looks them up among the keys and adds up the exact misses of
every pair.  Misses only grow, so a pair beyond the tolerance is dropped for good; a column without
pairs isn't read by later rounds, nor is a key without pairs looked at.  What is left after the last
round has been tested against every value.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylink.functions.frames import metadata_frame, union_all
from keylink.operators.inclusion import hits_by_pair, shared_rows
from keylink.operators.values import SLOTS
from keylink.sources.workspace import Workspace

# Slots of each round: one in 64 values, one in 9, the rest.
ROUNDS = ((0, 1), (1, 8), (8, SLOTS))


def rounds_for(sup_out_foreign_key: float, ratio_base: str = "rows") -> tuple[tuple[int, int], ...]:
    """ROUNDS without first ones that cover no more of the values than may miss.

    They would read every column and, but for hot values, refute nothing.
    """
    share = sup_out_foreign_key if ratio_base == "rows" else 0.0
    kept = [end for _, end in ROUNDS if end == SLOTS or end / SLOTS > share]
    return tuple(zip([0, *kept[:-1]], kept, strict=True))


@dataclass(frozen=True)
class Tested:
    """Outcome of all rounds: surviving pairs with their hits, and what was counted."""

    pairs: DataFrame
    counts: DataFrame | None
    read: tuple[tuple[int, ...], ...]


def surviving_in_rounds(
    spark: SparkSession,
    pairs: DataFrame,
    count: Callable[[Sequence[int], tuple[int, int]], DataFrame],
    uncounted: Sequence[int],
    key_counts: DataFrame,
    bases: Mapping[int, float],
    sup_out_foreign_key: float,
    workspace: Workspace,
    rounds: Sequence[tuple[int, int]] = ROUNDS,
) -> Tested:
    """``fk, pk, hits`` of the ``pairs`` within the tolerance.

    ``count`` returns the counted values (``cid, v, cnt``, written) of some columns in some slots;
    it is called for columns of ``uncounted``.  Other referring columns, and all keys, are in
    ``key_counts``.  ``read`` has the columns that each round read.
    """
    pairs = pairs.select("fk", "pk", F.lit(0).cast("bigint").alias("hits"))
    seen: dict[int, int] = {}
    parts: list[DataFrame] = []
    read: list[tuple[int, ...]] = []
    for first, end in rounds:
        alive = pairs.agg(
            F.collect_set("fk").alias("fks"), F.collect_set("pk").alias("pks")
        ).first()
        fks, pks = sorted(alive["fks"]), sorted(alive["pks"])
        scanned = [cid for cid in fks if cid in set(uncounted)]
        read.append(tuple(scanned))
        if not fks:
            continue
        rows = [key_counts.filter(F.col("slot").between(first, end - 1)).select("cid", "v", "cnt")]
        if scanned:
            counted = count(scanned, (first, end))
            parts.append(counted)
            rows.append(counted.select("cid", "v", "cnt"))
        counts = union_all(rows)
        refs = counts.filter(F.col("cid").isin(fks))
        for row in refs.groupBy("cid").agg(F.sum("cnt").alias("_n")).collect():
            seen[row["cid"]] = seen.get(row["cid"], 0) + row["_n"]
        # One shuffle by value for both roles: most keys refer as well.
        found = hits_by_pair(shared_rows(counts, fks, pks), len(pks), workspace)
        limits = metadata_frame(
            spark, [(cid, seen.get(cid, 0), float(bases[cid])) for cid in fks],
            "fk int, tested bigint, base double",
        )
        within = (F.col("tested") - F.col("hits")) / F.col("base") <= F.lit(float(sup_out_foreign_key))
        pairs = workspace.save(
            pairs.withColumnRenamed("hits", "_before")
            .join(found, ["fk", "pk"], "left")
            .join(limits, "fk")
            .withColumn("hits", F.col("_before") + F.coalesce("hits", F.lit(0)))
            .filter(within)
            .select("fk", "pk", "hits"),
            "pairs",
        )
    counts = union_all(parts) if parts else None
    return Tested(pairs, counts, tuple(read))
