"""Quotation linking: messages without their quotes, each linked to what it quotes.

A line's quote level is the number of ``>`` in front of it. Lines are normalised (lower case, one
space between words) and hashed. Each quoted line looks up the last earlier message of its
conversation that has the line at level 0; a message replies to the message that most of its least
deeply quoted lines come from, the later one on a tie. Linked quoted lines go, quotes of unknown
origin stay. ``place`` orders a conversation so that each message follows what it replies to.

Defined results: a null text is null and links with nothing; a null conversation is one; a null turn
comes first; repeated rows each stay, with the same links; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keylink.sources.workspace import Workspace

_MARKS = r"^[ \t]*(?:>[ \t]*)+"


def link_quotes(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Every row with ``reply_to`` (a turn, or null), ``n_quoted`` and ``n_linked`` lines, ``place``,
    ``clean_text`` and ``formatted``: the role and the clean text as one turn of a chat."""
    space = Workspace(messages.sparkSession)
    out = ("reply_to", "n_quoted", "n_linked", "place", "clean_text", "formatted")
    own = [c for c in messages.columns if c not in out]
    rows = space.save(
        messages.select(
            *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)],
            F.monotonically_increasing_id().alias("_row"),
            F.col(f"`{conversation}`").cast("string").alias("_conv"),
            F.coalesce(F.col(f"`{turn}`").cast("long"), F.lit(-(1 << 63))).alias("_turn"),
            F.col(f"`{role}`").cast("string").alias("_role"),
            F.col(f"`{text}`").alias("_text"),
        ),
        "messages",
    )
    lines = rows.select(
        "_row", "_conv", "_turn", F.posexplode(F.split("_text", "\n")).alias("_line", "_t")
    ).select(
        "_row", "_conv", "_turn", "_line",
        F.length(F.regexp_replace(F.regexp_extract("_t", _MARKS, 0), "[^>]", "")).alias("_level"),
        F.trim(F.lower(F.regexp_replace(F.regexp_replace("_t", _MARKS, ""), r"\s+", " "))).alias("_norm"),
    ).filter("_norm <> ''").withColumn("_hash", F.xxhash64("_norm")).drop("_norm")
    quoted = lines.filter("_level > 0")
    # only lines that are quoted somewhere in their conversation can be sources
    wanted = quoted.select(F.col("_conv").alias("_qc"), F.col("_hash").alias("_qh")).distinct()
    sources = (
        lines.filter("_level = 0")
        .join(wanted, F.col("_conv").eqNullSafe(F.col("_qc")) & (F.col("_hash") == F.col("_qh")), "left_semi")
        .select("_conv", "_hash", "_turn").distinct()
    )
    both = quoted.select("_conv", "_hash", "_turn", "_row", "_line", "_level").unionByName(
        sources, allowMissingColumns=True
    )
    earlier = F.max(F.when(F.col("_row").isNull(), F.col("_turn"))).over(
        Window.partitionBy("_conv", "_hash").orderBy("_turn").rangeBetween(Window.unboundedPreceding, -1)
    )
    linked = both.withColumn("_from", earlier).filter(F.col("_row").isNotNull())
    votes = (
        linked.filter("_from is not null").groupBy("_row", "_level", "_from").agg(F.count("*").alias("_n"))
    )
    parent = votes.groupBy("_row").agg(
        F.max_by("_from", F.struct(-F.col("_level"), F.col("_n"), F.col("_from"))).alias("reply_to")
    )
    told = linked.groupBy("_row").agg(
        F.count("*").alias("n_quoted"), F.count("_from").alias("n_linked"),
        F.collect_set(F.when(F.col("_from").isNotNull(), F.col("_line"))).alias("_gone"),  # one message's
    )
    done = (
        rows.join(told.withColumnRenamed("_row", "_r1"), F.col("_row") == F.col("_r1"), "left")
        .join(parent.withColumnRenamed("_row", "_r2"), F.col("_row") == F.col("_r2"), "left")
    )
    left = F.filter(F.split("_text", "\n"), lambda x, i: ~F.array_contains("_gone", i))
    clean = F.when(F.size("_gone") > 0, F.array_join(left, "\n")).otherwise(F.col("_text"))
    zero = F.lit(0).cast("long")
    return done.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)],
        "reply_to", F.coalesce("n_quoted", zero).alias("n_quoted"),
        F.coalesce("n_linked", zero).alias("n_linked"),
        F.col("_turn").alias("place"), clean.alias("clean_text"),
        F.concat(F.lit("<|"), F.coalesce("_role", F.lit("unknown")), F.lit("|>\n"), F.trim(clean)).alias("formatted"),
    )
