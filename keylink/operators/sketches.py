"""What can be said about columns and pairs of columns before any value is shuffled.

``column_statistics`` reads every column once: rows, distinct values by a HyperLogLog sketch, least
and greatest value.  ``column_sketches`` keeps, of each column, the values whose hash lies below a
cut that about ``SKETCH_VALUES`` distinct values pass, with their row counts; a column with fewer
values is kept whole.  Both are one row per column and can be merged: statistics by union, sketches
by the lower cut.

A value of a referring column below the cut of a key that the key's sketch lacks is a proven miss,
and so is a least value below the least key.  Hashes that collide can only hide a miss, so a pair
that is refuted here would be refused by the full test as well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keylink.functions.canonical import (
    INTEGRAL,
    TEXT,
    canonical_text,
    family,
    native_value,
    quoted,
    rendered,
)
from keylink.functions.frames import metadata_frame, union_all
from keylink.operators.inclusion import hits_by_pair
from keylink.operators.values import grouped_first
from keylink.sources.catalog import ColumnInfo, Source
from keylink.sources.workspace import Workspace

# Distinct values a sketch holds, about.
SKETCH_VALUES = 512
# Size of the HyperLogLog sketch as a power of two, and its relative standard error.
HLL_BITS = 12
HLL_ERROR = 1.04 / 2 ** (HLL_BITS / 2)
# A column is no key only if its estimate lies this many standard errors below its row count.
HLL_MARGIN = 5
# Hashes have 63 bits, so that they compare as they are stored.
TOP = (1 << 63) - 1
# Of texts, this many first characters are compared as least and greatest.
RANGE_CHARS = 64


def _hash(c: ColumnInfo) -> str:
    return f"shiftrightunsigned(xxhash64({canonical_text(c.name, c.dtype)}), 1)"


def _by_table(columns: Sequence[ColumnInfo]) -> dict[str, list[ColumnInfo]]:
    grouped: dict[str, list[ColumnInfo]] = {}
    for c in columns:
        grouped.setdefault(c.table, []).append(c)
    return grouped


def column_statistics(source: Source, columns: Sequence[ColumnInfo]) -> DataFrame:
    """``cid, row_count, non_null, distinct_sketch, low_int, high_int, low_text, high_text``.

    Least and greatest are those of integers, and of texts as far as ``RANGE_CHARS``; other
    families have none.  One scan per table, and one row of it is shuffled.
    """
    frames = []
    for table, items in _by_table(columns).items():
        inputs, aggregates, cells = [], [], []
        for c in items:
            kind, text = family(c.dtype), canonical_text(c.name, c.dtype)
            # Hashes in place of values: the sketch takes few types, and skips empty texts.  They
            # are worked out below the aggregation, which would evaluate them without compiling.
            value = text if kind == TEXT else native_value(c.name, c.dtype)
            inputs.append(f"CASE WHEN {quoted(c.name)} IS NOT NULL THEN xxhash64({value}) END AS x{c.cid}")
            aggregates += [
                f"count(x{c.cid}) AS n{c.cid}", f"hll_sketch_agg(x{c.cid}, {HLL_BITS}) AS d{c.cid}"
            ]
            ranges = ["CAST(NULL AS BIGINT)"] * 2 + ["CAST(NULL AS STRING)"] * 2
            if kind in (INTEGRAL, TEXT):
                first = value if kind == INTEGRAL else f"left({text}, {RANGE_CHARS})"
                inputs.append(f"{first} AS r{c.cid}")
                aggregates += [f"min(r{c.cid}) AS l{c.cid}", f"max(r{c.cid}) AS h{c.cid}"]
                at = 0 if kind == INTEGRAL else 2
                ranges[at:at + 2] = [f"l{c.cid}", f"h{c.cid}"]
            cells.append(f"{c.cid}, n{c.cid}, d{c.cid}, {', '.join(ranges)}")
        frames.append(
            source.tables[table].selectExpr(*inputs)
            .selectExpr("count(1) AS row_count", *aggregates).selectExpr(
                "row_count",
                f"stack({len(items)}, {', '.join(cells)}) AS (cid, non_null, distinct_sketch, "
                "low_int, high_int, low_text, high_text)",
            )
        )
    return union_all(frames).select(
        "cid", "row_count", "non_null", "distinct_sketch", "low_int", "high_int", "low_text",
        "high_text",
    )


def merge_statistics(statistics: DataFrame) -> DataFrame:
    """Statistics of parts of a table as those of the whole."""
    return statistics.groupBy("cid").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("non_null").alias("non_null"),
        F.expr("hll_union_agg(distinct_sketch)").alias("distinct_sketch"),
        F.min("low_int").alias("low_int"),
        F.max("high_int").alias("high_int"),
        F.min("low_text").alias("low_text"),
        F.max("high_text").alias("high_text"),
    )


def distinct_estimate() -> Column:
    return F.expr("hll_sketch_estimate(distinct_sketch)")


def may_be_unique() -> Column:
    """False only for columns that have a NULL or, beyond doubt, a repeat."""
    enough = distinct_estimate() >= F.col("row_count") * F.lit(1 - HLL_MARGIN * HLL_ERROR)
    return (F.col("non_null") == F.col("row_count")) & enough


def column_sketches(
    source: Source,
    columns: Sequence[ColumnInfo],
    estimates: Mapping[int, int],
    size: int = SKETCH_VALUES,
) -> DataFrame:
    """``cid, cut, entries``: hashes up to ``cut`` in rising order, each with its row count."""
    spark = next(iter(source.tables.values())).sparkSession
    cuts = {
        c.cid: TOP if estimates[c.cid] <= size else TOP * size // estimates[c.cid]
        for c in columns
    }
    # Where few values repeat, they are grouped before their texts are made for the hashes.
    few = grouped_first(columns, estimates)
    grouped = {c.cid for c in few}
    long = []
    for table, items in _by_table([c for c in columns if c.cid not in grouped]).items():
        cells = ", ".join(
            f"{c.cid}, CASE WHEN {quoted(c.name)} IS NOT NULL THEN {_hash(c)} END, {cuts[c.cid]}L"
            for c in items
        )
        long.append(
            source.tables[table].selectExpr(f"stack({len(items)}, {cells}) AS (cid, h, cut)")
            .filter("h <= cut").selectExpr("cid", "h", "1L AS n")
        )
    for kind in dict.fromkeys(family(c.dtype) for c in few):
        native = []
        for table, items in _by_table([c for c in few if family(c.dtype) == kind]).items():
            cells = ", ".join(
                f"{c.cid}, {native_value(c.name, c.dtype)}, {cuts[c.cid]}L" for c in items
            )
            native.append(
                source.tables[table].selectExpr(f"stack({len(items)}, {cells}) AS (cid, x, cut)")
                .filter("x IS NOT NULL")
            )
        counted = union_all(native).groupBy("cid", "cut", "x").agg(F.count(F.lit(1)).alias("n"))
        hashed = f"shiftrightunsigned(xxhash64({rendered('x', kind)}), 1) AS h"
        long.append(counted.selectExpr("cid", hashed, "cut", "n").filter("h <= cut").select("cid", "h", "n"))
    entries = (
        union_all(long).groupBy("cid", "h").agg(F.sum("n").alias("n")).groupBy("cid")
        .agg(F.sort_array(F.collect_list(F.struct("h", "n"))).alias("entries"))
    )
    cut = metadata_frame(spark, list(cuts.items()), "cid int, cut bigint")
    none = F.expr("CAST(array() AS array<struct<h: bigint, n: bigint>>)")
    return cut.join(entries, "cid", "left").select(
        "cid", "cut", F.coalesce("entries", none).alias("entries")
    )


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of parts of a table as one: hashes up to the lowest cut, their counts added."""
    cut = sketches.groupBy("cid").agg(F.min("cut").alias("cut"))
    entries = (
        sketches.select("cid", F.explode("entries").alias("_e")).select("cid", "_e.h", "_e.n")
        .join(cut, "cid").filter("h <= cut")
        .groupBy("cid", "cut", "h").agg(F.sum("n").alias("n"))
        .groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("h", "n"))).alias("entries"))
    )
    none = F.expr("CAST(array() AS array<struct<h: bigint, n: bigint>>)")
    return cut.join(entries, "cid", "left").select(
        "cid", "cut", F.coalesce("entries", none).alias("entries")
    )


def repeats() -> Column:
    """A value of the sketch occurs twice or more, so the column isn't unique."""
    return F.exists("entries", lambda e: e["n"] > 1)


def surviving_pairs(
    spark: SparkSession,
    sketches: DataFrame,
    statistics: DataFrame,
    refs: Sequence[tuple[int, str, float]],
    keys: Sequence[tuple[int, str]],
    sup_out_foreign_key: float,
    workspace: Workspace | None = None,
) -> DataFrame:
    """``fk, pk`` of the pairs that neither sketches nor ranges refute.

    ``refs`` are (cid, table, base of the miss ratio), ``keys`` (cid, table).  Pairs are catalog
    rows; hashes meet by value only, through :func:`hits_by_pair`.
    """
    sup = F.lit(float(sup_out_foreign_key))
    limits = metadata_frame(spark, refs, "fk int, fk_table string, base double")
    named = metadata_frame(spark, keys, "pk int, pk_table string")
    ranges = statistics.select(
        "cid", (F.col("row_count") - F.col("non_null")).alias("nulls"), "low_int", "high_int",
        "low_text", "high_text",
    )

    def allowed(misses: Column) -> Column:
        return misses / F.col("base") <= sup

    entries = sketches.select("cid", F.explode("entries").alias("_e")).select("cid", "_e.h", "_e.n")
    fks = limits.join(ranges.withColumnRenamed("cid", "fk"), "fk").filter(allowed(F.col("nulls")))
    pks = named.join(ranges.drop("nulls").toDF("pk", "_pli", "_phi", "_plt", "_pht"), "pk").join(
        sketches.select(F.col("cid").alias("pk"), "cut"), "pk"
    )
    # The hash up to which a key without any hit would have to reach to be refuted.
    reach = (
        entries.withColumnRenamed("cid", "fk")
        .join(fks.select("fk", "base", "nulls"), "fk")
        .withColumn("_running", F.sum("n").over(Window.partitionBy("fk").orderBy("h")))
        .filter(~allowed(F.col("nulls") + F.col("_running")))
        .groupBy("fk").agg(F.min("h").alias("_reach"))
    )
    outside = F.lit(False)
    for low, high, key_low, key_high in (
        ("low_int", "high_int", "_pli", "_phi"), ("low_text", "high_text", "_plt", "_pht"),
    ):
        outside |= F.coalesce(F.col(low) < F.col(key_low), F.lit(False))
        outside |= F.coalesce(F.col(high) > F.col(key_high), F.lit(False))
    met = (
        fks.join(reach, "fk", "left").join(pks, F.col("fk_table") != F.col("pk_table"))
        .filter(~outside | allowed(F.col("nulls") + F.lit(1)))
        .select("fk", "pk", "base", "nulls", "cut", "_reach")
    )
    cid = F.col("cid")
    ref_ids, key_ids = [r[0] for r in refs], [k[0] for k in keys]
    hits = hits_by_pair(
        entries.filter(cid.isin(sorted({*ref_ids, *key_ids}))).select(
            F.col("h").alias("v"), "cid",
            F.when(cid.isin(ref_ids), F.col("n")).alias("cnt"), cid.isin(key_ids).alias("is_pk"),
        ),
        len(key_ids),
        workspace,
    )
    paired = met.join(hits, ["fk", "pk"], "left")
    unmet = paired.filter(
        F.col("hits").isNull() & (F.col("_reach").isNull() | (F.col("cut") < F.col("_reach")))
    )
    tested = F.aggregate(
        F.filter("entries", lambda e: e["h"] <= F.col("cut")),
        F.lit(0).cast("bigint"), lambda total, e: total + e["n"],
    )
    # Only pairs with a hit need the sketch of the referring column beside them.
    hit = (
        paired.filter(F.col("hits").isNotNull())
        .join(sketches.select(F.col("cid").alias("fk"), "entries"), "fk")
        .filter(allowed(F.col("nulls") + tested - F.col("hits")))
    )
    return unmet.select("fk", "pk").unionByName(hit.select("fk", "pk"))
