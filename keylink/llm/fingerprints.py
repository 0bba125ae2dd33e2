"""SimHash fingerprints of 128 bits, with DataFrame functions alone.

Terms are pairs of neighbouring words in lower case (a single word for a text of one). A term weighs
the length of its words, each up to 16 characters, so that short function words count little, and
votes with that weight for the set bits of its hash and against the others. Permuted block tables
find all fingerprints within a Hamming radius: of ``blocks`` blocks, two fingerprints that differ in
``radius`` bits agree on all but ``radius``, so each choice of that many blocks is a table's key. With
fewer blocks than that, one block differs in radius / blocks bits at most, so each block is a table, in
which a query looks up its own block and all blocks that differ from it in so few bits.

Near copies are searched within ``NEAR`` of 128 bits: a changed word in 300 flips 5 bits on average, three
flip 10. Each document has ``class_id``, the least id with its fingerprint; a query's ``near_classes`` are the
class ids within that radius, its own included, so that class_id tells all partners.

Defined results: null and empty texts have no terms and the fingerprint 0; equal texts have equal
ones; a text of up to 67 million words can't overflow a counter. Order by id puts null ids first;
rows of one id follow each other by text. An empty table stays empty.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keylink.sources.workspace import Workspace

BITS = 128
# Radius of near copies and its blocks: one of 8 blocks differs in one bit at most.
NEAR, NEAR_BLOCKS = 15, 8
_LANES = 0x0000000100000001  # a counter of 32 bits for bit j, another for bit j + 32
_LEAST = -(1 << 63)


def terms(text: Column) -> Column:
    """array<struct<h, w>> of a text's terms."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")

    def term(word: Column, following: Column) -> Column:
        weight = F.least(F.length(word), F.lit(16)) + F.coalesce(
            F.least(F.length(following), F.lit(16)), F.lit(0)
        )
        return F.struct(F.xxhash64(word, following).alias("h"), weight.cast("long").alias("w"))

    # The words are an argument, never part of the function: that is run for every word.
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), term)
    return F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(1)))


def votes(frame: DataFrame, keys: list[str]) -> DataFrame:
    """keys, f0 and f1 for rows of keys and ``terms``; each distinct key is one text."""
    one = frame.select(*keys, F.explode_outer("terms").alias("x")).select(
        *keys, F.col("x.h").alias("h0"), F.xxhash64("x.h").alias("h1"), F.col("x.w").alias("w")
    )
    lane = F.lit(_LANES)
    sums = [
        F.sum(F.shiftrightunsigned(h, j).bitwiseAND(lane) * F.col("w")).alias(f"{h}_{j}")
        for h in ("h0", "h1") for j in range(32)
    ]
    counted = one.groupBy(*keys).agg(F.sum("w").alias("all"), *sums)

    def bits(h: str) -> Column:
        out = F.lit(0).cast("long")
        for j in range(32):
            count = F.col(f"{h}_{j}")
            low = count.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("all")
            high = F.shiftrightunsigned(count, 32) * 2 > F.col("all")
            top = _LEAST if j == 31 else 1 << (j + 32)
            out = out.bitwiseOR(F.when(low, F.lit(1 << j)).otherwise(F.lit(0)).cast("long"))
            out = out.bitwiseOR(F.when(high, F.lit(top)).otherwise(F.lit(0)).cast("long"))
        return out

    return counted.select(*keys, bits("h0").alias("f0"), bits("h1").alias("f1"))


def shown(f0: Column, f1: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(f)), 16, "0") for f in (f0, f1)])


def different(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return 1 - different(a0, a1, b0, b1) / F.lit(float(BITS))


def within_radius(
    queries: DataFrame, fingerprints: DataFrame, radius: int = 3, blocks: int = 4
) -> DataFrame:
    """(q0, q1, f0, f1): each distinct query fingerprint with every distinct one in its radius."""
    if BITS % blocks:
        raise ValueError("blocks must divide the bits")
    width = BITS // blocks
    if width > 32:
        raise ValueError("a block has 32 bits at most")
    per = 64 // width

    def block(i: int, names: tuple[str, str]) -> Column:
        part = F.shiftrightunsigned(names[i // per], width * (i % per))
        return part.bitwiseAND(F.lit((1 << width) - 1))

    # fewer blocks than differing bits: tables of one block, with this many bits flipped in the query's
    flips = radius // blocks
    alone = range(1) if not flips else [
        sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(width), n)
    ]
    each = 1 if flips else blocks - radius

    def keys_of(n: int, chosen: tuple[int, ...], names: tuple[str, str], masks) -> Column:
        def key(mask: Column) -> Column:
            parts = [block(i, names).bitwiseXOR(mask) for i in chosen]
            return F.struct(F.lit(n).alias("n"), F.xxhash64(*parts).alias("k"))

        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), key)

    def tables(frame: DataFrame, names: tuple[str, str], masks=range(1)) -> DataFrame:
        keys = [keys_of(n, chosen, names, masks) for n, chosen in enumerate(combinations(range(blocks), each))]
        return frame.select(*names, F.explode(F.concat(*keys)).alias("key"))

    asked = queries.select(F.col("f0").alias("q0"), F.col("f1").alias("q1")).distinct()
    left = tables(asked, ("q0", "q1"), alone)
    right = tables(fingerprints.select("f0", "f1").distinct(), ("f0", "f1"))
    near = different(F.col("q0"), F.col("q1"), F.col("f0"), F.col("f1")) <= radius
    return left.join(right, "key").filter(near).drop("key").distinct()


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """bucket, ord, guard, key, text, next_text by ascending key, cyclic. Guard rows copy the first
    row of the following bucket, so that no bucket needs another one."""
    plain = docs.select(
        F.col(f"`{key}`").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    ).withColumn("k", F.coalesce(F.col("doc").cast("long"), F.lit(_LEAST)))
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(plain.agg(F.percentile_approx("k", shares, 100 * parts)).first()[0] or []))
    limits = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else None
    place = F.size(F.filter(limits, lambda b: b < F.col("k"))) if bounds else F.lit(0)
    plain = plain.withColumn("bucket", place)
    # one row a bucket, of which there are as many as partitions
    first = {r["bucket"]: r["k"] for r in plain.groupBy("bucket").agg(F.min("k").alias("k")).collect()}
    order = sorted(first)
    before = {first[b]: order[i - 1] for i, b in enumerate(order)}
    pairs = [F.lit(x).cast(t) for k, b in before.items() for x, t in ((k, "long"), (b, "int"))]
    guard_of = F.element_at(F.create_map(*pairs), F.col("k")) if pairs else F.lit(None).cast("int")
    rows = plain.withColumn("guard_of", guard_of).select(
        "doc", "k", "text",
        F.explode(
            F.when(
                F.col("guard_of").isNull(),
                F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guard"))),
            ).otherwise(
                F.array(
                    F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guard")),
                    F.struct(F.col("guard_of").alias("bucket"), F.lit(True).alias("guard")),
                )
            )
        ).alias("at"),
    ).select("doc", "k", "text", "at.bucket", "at.guard")
    w = Window.partitionBy("bucket").orderBy("guard", "k", "text")
    return rows.withColumn("ord", F.row_number().over(w)).withColumn(
        "next_text", F.lead("text").over(w)
    )


def edited(text: Column, following: Column) -> Column:
    """The last quarter (rounded down) replaced by as much of the following text's beginning."""
    n, m = F.length(text), F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - m), F.substring(following, F.lit(1), m))


def compare_with_edits(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, blocks: int = 4
) -> DataFrame:
    """Per document its fingerprint, that of its edited text, likenesses to that and to the next
    document's, ``class_id``, and, for ids divisible by 100, ``n_near``: documents within the radius, and
    ``near_classes``: ascending class ids within NEAR bits."""
    rows = with_next(docs, key, text).withColumn(
        "edited", F.when(~F.col("guard"), edited(F.col("text"), F.col("next_text")))
    )
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("t")),
        F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")),
    )
    # doc is carried along so that votes and facts below ask for the same columns, and share one
    # shuffle of the texts
    keys = ["bucket", "ord", "guard", "side", "doc"]
    texts = rows.select("bucket", "ord", "guard", "doc", F.explode(sides).alias("s")).select(
        "bucket", "ord", "guard", "s.side", "doc", terms(F.col("s.t")).alias("terms")
    )
    prints = votes(texts.filter("not guard or side = 0"), keys)
    by_row = prints.groupBy("bucket", "ord", "guard").agg(
        *[F.max(F.when(F.col("side") == s, F.col(f))).alias(f"{n}{f[1]}")
          for s, n in ((0, "f"), (1, "e")) for f in ("f0", "f1")]
    )
    w = Window.partitionBy("bucket").orderBy("ord")
    by_row = by_row.select(
        "*", F.lead("f0").over(w).alias("x0"), F.lead("f1").over(w).alias("x1")
    ).filter("not guard").drop("guard")
    facts = rows.filter("not guard").select(
        "bucket", "ord", "doc", F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
    )
    done = Workspace(docs.sparkSession).save(
        facts.join(by_row, ["bucket", "ord"]).drop("bucket", "ord"), "fingerprints"
    )
    asked = done.filter("doc % 100 = 0")
    classes = Workspace(docs.sparkSession).save(
        done.groupBy("f0", "f1").agg(F.count("*").alias("n"), F.min("doc").alias("class_id")), "classes"
    )
    apart = different(F.col("q0"), F.col("q1"), F.col("f0"), F.col("f1"))
    wide = (NEAR, NEAR_BLOCKS) if radius <= NEAR else (radius, blocks)
    found = (
        within_radius(asked, classes, *wide).join(classes, ["f0", "f1"])
        .groupBy("q0", "q1").agg(
            F.sum(F.when(apart <= radius, F.col("n"))).alias("n_near"),
            F.sort_array(F.collect_list(F.when(apart <= NEAR, F.col("class_id")))).alias("near_classes"),
        )
    )
    counted = asked.select("doc", "f0", "f1").distinct().join(
        found, (F.col("f0") == F.col("q0")) & (F.col("f1") == F.col("q1"))
    ).select(
        F.col("doc").alias("doc2"), F.col("f0").alias("g0"), F.col("f1").alias("g1"), "n_near", "near_classes"
    )
    member = classes.select(F.col("f0").alias("m0"), F.col("f1").alias("m1"), "class_id")
    done = done.join(member, (F.col("f0") == F.col("m0")) & (F.col("f1") == F.col("m1")))
    same = (F.col("doc") == F.col("doc2")) & (F.col("f0") == F.col("g0")) & (F.col("f1") == F.col("g1"))
    f, e, x = [(F.col(f"{n}0"), F.col(f"{n}1")) for n in "fex"]
    return done.join(counted, same, "left").select(
        F.col("doc").alias(key), "n_chars", "edited_sha256",
        shown(*f).alias("fingerprint"), shown(*e).alias("edited_fingerprint"),
        likeness(*f, *e).alias("near_edited"), likeness(*f, *x).alias("near_next"), "n_near",
        "class_id", "near_classes",
    )
