"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone.

A source with n documents and target weight w gets the mean repetition rate w * total / n, weights
being scaled to sum 1. Each document's count inverts a Poisson distribution of that mean at a
uniform number that comes from a hash of seed and id. A document is exploded by its count, and all
copies are dealt out by another hash and sorted by it within each partition: a global shuffle.

Defined results: a source without a positive weight in ``weights`` goes; a null source is a source;
without ``weights`` a source weighs its count to the power ``temperature``. A null id hashes as the
text 'null'. Repeated rows of one id share their count and are told apart by nothing else. A null
text stays null. An empty table stays empty. An input column that bears the name of a result column
is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rates are broadcast up to this number of sources; beyond it they are joined, hot sources salted.
BROADCAST_SOURCES = 100_000
SALTS = 64
_UNIT = float(1 << 52)


def hash_bits(digits: int, *parts: Column) -> Column:
    """The first hexadecimal digits (15 at most) of an md5 of the parts, as a number."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def poisson_bounds(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as far as double precision tells them from 1.

    Beyond the last term lies a probability of less than 2^-60, under the grain of the uniform
    numbers. Terms are taken from logarithms, so that large rates don't underflow.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")

    def step(state: Column, k: Column) -> Column:
        log_factorial = state["f"] + F.log(k.cast("double"))
        sum_ = state["s"] + F.exp(k * F.log(rate) - rate - log_factorial)
        return F.struct(
            log_factorial.alias("f"), sum_.alias("s"), F.array_append(state["c"], sum_).alias("c")
        )

    none = F.exp(-rate)
    start = F.struct(F.lit(0.0).alias("f"), none.alias("s"), F.array(none).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step)["c"]


def repetition_rates(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    total: float | None = None,
    source: str = "source",
    temperature: float = 0.5,
) -> DataFrame:
    """(source, rate, bounds) for each source with a positive weight; total: documents wanted."""
    counts = docs.groupBy(F.col(f"`{source}`").cast("string").alias("_source")).agg(
        F.count("*").alias("_n")
    )
    if weights is None:
        weight = F.pow(F.col("_n").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(None).cast("double")
        for name, w in weights.items():
            weight = F.when(F.col("_source").eqNullSafe(F.lit(name)), float(w)).otherwise(weight)
    counts = counts.withColumn("_w", weight).filter("_w > 0")
    # a single row of sums, whatever the number of sources
    sums = counts.agg(F.sum("_w").alias("_all_w"), F.sum("_n").alias("_all_n"))
    wanted = F.col("_all_n") if total is None else F.lit(float(total))
    rate = F.col("_w") / F.col("_all_w") * wanted / F.col("_n")
    return (
        counts.join(F.broadcast(sums))
        .select("_source", rate.alias("_rate"))
        .withColumn("_bounds", poisson_bounds(F.col("_rate")))
    )


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    total: float | None = None,
    seed: int = 0,
    source: str = "source",
    key: str = "doc_id",
    temperature: float = 0.5,
) -> DataFrame:
    """Every copy with the input columns, ``copy`` (from 0) and ``shuffle_key``."""
    rates = repetition_rates(docs, weights, total, source, temperature)
    own = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    plain = docs.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)],
        F.col(f"`{source}`").cast("string").alias("_src"),
        F.col(f"`{key}`").alias("_key"),
    )
    same = F.col("_src").eqNullSafe(F.col("_source"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = plain.join(F.broadcast(rates), same)
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt2")
        joined = plain.withColumn("_salt", hash_bits(8, F.lit("salt"), F.col("_key")) % SALTS).join(
            rates.select("*", salt), same & (F.col("_salt") == F.col("_salt2"))
        )
    uniform = (hash_bits(13, F.lit(seed), F.col("_key")).cast("double") + 0.5) / F.lit(_UNIT)
    count = F.size(F.filter("_bounds", lambda b: b <= F.col("_u")))
    copies = (
        joined.withColumn("_u", uniform)
        .withColumn("_count", count)
        .filter("_count > 0")
        .select(
            *[f"_c{i}" for i in range(len(own))],
            "_key",
            F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("copy"),
        )
        .withColumn(
            "shuffle_key", hash_bits(15, F.lit(seed), F.lit("order"), F.col("_key"), F.col("copy"))
        )
    )
    return (
        copies.repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key")
        .select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], "copy", "shuffle_key")
    )
