"""Near duplicates by a chosen-path set similarity join.

A document's set are its distinct five-word shingles; equal sets are one class from the start. Each
class has minwise tokens at ``POSITIONS`` positions. ``TREES`` independent trees split the classes
by the tokens at ``ROOT`` positions of its own: by one alone, all texts that share a passage would
meet there. A node is compared exhaustively once all but ``LEAF`` of its
classes belong to one component: those few against all. Any other node compares its members with
``PIVOTS`` pivots first. Nodes that then lie in one component are done, which is what ends large
groups of near copies in linear work; those with few others left are compared exhaustively. Only
the rest branch again: four levels of the path at once, by the tokens at ``STEP`` positions that the
path selects, into (1/threshold)^4 children, 2 for 85 % and 3 for 80 %, so that a pair at the
threshold is expected in one. Pairs are screened by their sizes and by two bits of each
minwise token, below the root by an odd sketch as well, then confirmed on the full sets. An odd
sketch has the parity of the shingles that hash to each bit; two of them differ in as many bits as
the sets differ in shingles at most, so it never drops a link.

A pair at 85 % is missed by the root's split of all 18 trees with a chance of (1 - 0.85^2)^18 = 1e-10. Each
step that its nodes branch adds to that: paths choose among ``POSITIONS`` tokens, and averaged over how many
of these a pair shares, 18 trees miss it with 1.5e-4 after one step, 2e-3 after two, 1e-2 after three, 4e-2
after five and 0.15 after ten. Hence all sets of nodes that went so deep go through 18 more trees, with
minwise tokens of their own, as often as it takes for a chance of ``MISS`` (2e-4): twice from two steps on,
three times from five, five times at ten. ``_missed`` has the chance by depth; at 80 % it is 4e-4 after
one step, so that sets go twice from there on. The bit screen drops a pair with up to 1e-8.

Defined results: null, empty or wordless texts have no shingles and link with nothing; a row with a
null id links with nothing, has a null component and stays; repeated rows share a component, of
which each row with the least id counts as kept unless ``one_row`` picks one of them; an empty table
gives an empty table; all input columns stay but those that a result column of that name replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keylink.llm import textarrays as ta
from keylink.llm.components import components
from keylink.sources.workspace import Workspace

WORDS = 5
PERCENT = 85
TREES = 18
# Tokens that sets have in common in a root node. Trees times this is POSITIONS at most.
ROOT = 2
POSITIONS = 64
# Small at the root; below it pivots have joined most of a large node, and few pairs are left to see.
LEAF = (32, 256)
PIVOTS = 8
# A step below the root takes this many positions at once.
STEP = 4
# The chance that the bit screen drops a pair at the threshold.
SCREENED = 1e-8
# The chance to miss a pair at the threshold, however deep its nodes branch.
MISS = 2e-4
# Longs of an odd sketch. It parts sets of up to about 1,500 shingles; larger ones it lets pass.
SKETCH = 8

_U32 = np.uint32


def _children(percent: int) -> int:
    """Children of a node, so that a pair at the threshold is expected in one: 2 for 85, 3 for 80."""
    return -(-(100**STEP) // percent**STEP)


def _max_different(percent: int) -> int:
    """How many pairs of bits may differ: 24 for 85, 28 for 80. Other tokens have equal bits in 1/4."""
    q = 0.75 * (1 - percent / 100)
    chance = [comb(POSITIONS, k) * q**k * (1 - q) ** (POSITIONS - k) for k in range(POSITIONS + 1)]
    return next(k for k in range(POSITIONS + 1) if sum(chance[k + 1 :]) <= SCREENED)


def _sets(c: ta.Chunk):
    """Distinct shingle hashes by document, in order: (values, number in each document)."""
    hashes, doc, _ = c.shingles(WORDS, c.word_hashes(lower=True), whole=True)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.bincount(doc[new], minlength=c.hi - c.lo)


def _keys(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A 16-byte name for each set; null for an empty one."""
    ends = np.cumsum(counts)
    out = np.zeros((len(counts), 2), dtype=np.uint64)
    for which in range(2):
        out[:, which] = ta.window_hashes(values, ends - counts, ends, which)
    flat = out.tobytes()
    return pa.array(
        [flat[16 * i : 16 * i + 16] if n else None for i, n in enumerate(counts.tolist())],
        pa.binary(),
    )


@cache
def _missed(percent: int, depth: int) -> float:
    """The chance that TREES trees miss a pair at the threshold in nodes that branch depth times."""
    p, total = percent / 100, 0.0
    for shared in range(POSITIONS + 1):  # of the pair's tokens
        r, found = shared / POSITIONS, 1.0
        for _ in range(depth):
            found = 1 - (1 - r**STEP * found) ** _children(percent)
        chance = comb(POSITIONS, shared) * p**shared * (1 - p) ** (POSITIONS - shared)
        total += chance * (1 - r**ROOT * found) ** TREES
    return total


def _rounds(percent: int, depth: int) -> int:
    """How many times TREES trees with fresh tokens it takes for a chance of MISS."""
    return ceil(log(MISS) / log(_missed(percent, depth)))


def _minwise(values: np.ndarray, counts: np.ndarray, turn: int = 0):
    """Minwise tokens (documents x positions), and two bits of each packed into two integers."""
    salt = (ta.seeds(POSITIONS, 5000 + 10_000 * turn) >> np.uint64(32)).astype(_U32)
    odd = (ta.seeds(POSITIONS, 6000 + 10_000 * turn) >> np.uint64(32)).astype(_U32) | _U32(1)
    has = np.flatnonzero(counts)
    begin = (np.cumsum(counts) - counts)[has]
    tokens = np.zeros((len(counts), POSITIONS), dtype=_U32)
    if len(has):
        low = (values >> np.uint64(32)).astype(_U32)
        for i in range(POSITIONS):
            x = (low ^ salt[i]) * odd[i]
            x ^= x >> _U32(15)
            x *= _U32(0x2C1B3C6D)
            x ^= x >> _U32(13)
            tokens[has, i] = np.minimum.reduceat(x, begin)
    bits = np.zeros((2, len(counts)), dtype=np.uint64)
    for i in range(POSITIONS):
        two = ((tokens[:, i] * _U32(0x9E3779B1)) >> _U32(30)).astype(np.uint64)
        bits[i // 32] |= two << np.uint64(2 * (i % 32))
    return tokens, bits


def _odd_sketch(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SKETCH integers for each document, whose bits are the parities of its shingles' hashes."""
    doc = np.repeat(np.arange(len(counts)), counts)
    bit = values % np.uint64(64 * SKETCH)
    out = np.zeros(len(counts) * SKETCH, dtype=np.uint64)
    place = doc * SKETCH + (bit // np.uint64(64)).astype(np.int64)
    np.bitwise_xor.at(out, place, np.uint64(1) << (bit % np.uint64(64)))
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.num_columns - 1
        for c in ta.chunks(batch.column(own)):
            values, counts = _sets(c)
            tokens, bits = _minwise(values, counts)
            cols = [batch.column(i)[c.lo : c.hi] for i in range(own)]
            cols += [
                pa.array(counts, pa.int64()),
                _keys(values, counts),
                ta.lists(tokens.ravel().view(np.int32), np.full(len(counts), POSITIONS), pa.int32()),
                ta.signed(bits[0]),
                ta.signed(bits[1]),
                ta.lists(_odd_sketch(values, counts), np.full(len(counts), SKETCH), pa.int64()),
            ]
            names = [*batch.schema.names[:own], "n_shingles", "_set", "_tokens", "_b0", "_b1", "_odd"]
            yield pa.RecordBatch.from_arrays(cols, names)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets of the texts in the first column whose names the second one lists."""
    for batch in batches:
        for c in ta.chunks(batch.column(0)):
            values, counts = _sets(c)
            names = _keys(values, counts)
            asked = batch.column(1)[c.lo : c.hi].to_pylist()
            wanted = pa.array([n in a for n, a in zip(names.to_pylist(), asked, strict=True)], pa.bool_())
            full = pa.RecordBatch.from_arrays([names, ta.lists(values, counts, pa.int64())], ["_set", "_all"])
            yield full.filter(wanted)


def _large(level: int) -> Column:
    return F.col("rest") > LEAF[min(level, 1)]


def _candidates(rows: DataFrame, stats: DataFrame, level: int, percent: int) -> DataFrame:
    """Screened pairs (a, b) of one level. rows: node, s (set), c (component), n and bits."""
    few = stats.filter(~_large(level))
    many = stats.filter(_large(level))
    likely = _likely if level == 0 else _likelier
    item = F.struct(*[c for c in rows.columns if c != "node"])
    joined = rows.join(few.select("node", "main"), "node")
    rest = (
        joined.filter("c <> main").groupBy("node")
        .agg(F.collect_list(item).alias("others"))  # as many as a leaf has at most
        .withColumnRenamed("node", "node2")
    )
    small = joined.join(rest, F.col("node") == F.col("node2")).select(*rows.columns, "others")
    pivots = (
        rows.join(many.select("node"), "node").groupBy("node")
        .agg(
            F.array(
                *[F.min_by(item, F.xxhash64("s", F.lit(level), F.lit(i))) for i in range(PIVOTS)]
            ).alias("others")
        )
        .withColumnRenamed("node", "node2")
    )
    large = rows.join(pivots, F.col("node") == F.col("node2")).select(*rows.columns, "others")
    # screened inside the row, so that only pairs worth confirming become rows
    near = small.union(large).select("s", F.explode(F.filter("others", lambda o: likely(o, percent))).alias("o"))
    return near.select(F.least("s", "o.s").alias("a"), F.greatest("s", "o.s").alias("b")).distinct()


def _likely(o: Column, percent: int) -> Column:
    """Whether a member (columns s, c, n, b0, b1) may be near another one of other component."""
    sizes = F.least("n", o["n"]) * 100 >= F.greatest("n", o["n"]) * percent
    different = F.lit(0)
    for b in ("b0", "b1"):
        bits = F.col(b).bitwiseXOR(o[b])
        pairs = bits.bitwiseOR(F.shiftrightunsigned(bits, 1)).bitwiseAND(F.lit(0x5555555555555555))
        different = different + F.bit_count(pairs)
    return (F.col("c") != o["c"]) & sizes & (different <= _max_different(percent))


def _likelier(o: Column, percent: int) -> Column:
    """The same with odd sketches: sets of n and m at 85 % differ in 15/185 of n + m, at 80 % in 20/180."""
    apart = F.aggregate(
        F.zip_with("odd", o["odd"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, b: a + b
    )
    return _likely(o, percent) & (apart * (100 + percent) <= (F.col("n") + o["n"]) * (100 - percent))


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    one = full.select(F.col("_set").alias("a"), F.col("_all").alias("x"))
    two = full.select(F.col("_set").alias("b"), F.col("_all").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(one, "a").join(two, "b").withColumn("i", shared)
        .filter(F.col("i") * 100 >= (F.size("x") + F.size("y") - F.col("i")) * percent)
        .select("a", "b")
    )


def _stats(rows: DataFrame) -> DataFrame:
    """(node, main, rest) of the nodes that hold more than one component: the one with most of their
    members, and how many belong to others. Counted by component before the shuffle."""
    held = rows.groupBy("node", "c").agg(F.count("*").alias("k"))
    return (
        held.groupBy("node")
        .agg(F.sum("k").alias("all"), F.max("k").alias("most"), F.max_by("c", "k").alias("main"))
        .select("node", "main", (F.col("all") - F.col("most")).alias("rest"))
        .filter("rest > 0")
    )


def _labelled(member: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Sets, one row each, with their component c."""
    if labels is None:
        return member.withColumn("c", F.col("s"))
    found = labels.select(F.col("s").alias("s2"), F.col("c").alias("c2"))
    member = member.join(found, F.col("s") == F.col("s2"), "left")
    return member.withColumn("c", F.coalesce("c2", "s")).drop("s2", "c2")


def _branch(rows: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """Members of the nodes that aren't done, in the children that their paths choose."""
    def child(j: int) -> Column:
        token = [F.pmod(F.xxhash64("node", F.lit(i)), F.lit(POSITIONS)) for i in range(STEP * j, STEP * j + STEP)]
        parts = [x for p in token for x in (p, F.get("t", p.cast("int")))]
        return F.xxhash64("node", F.lit(j), *parts)

    return (
        rows.join(open_.select("node"), "node")
        .withColumn("node", F.explode(F.array(*[child(j) for j in range(_children(percent))])))
    )


def _label(sets: DataFrame, full, space: Workspace, percent: int) -> DataFrame | None:
    """(s, c): the component of every set that isn't its own, or None if there is no link."""
    member = sets.select(
        F.col("_set").alias("s"), F.col("n_shingles").cast("int").alias("n"),
        F.col("_b0").alias("b0"), F.col("_b1").alias("b1"), F.col("_tokens").alias("t"),
        F.col("_odd").alias("odd"),
    )
    active, labels, fetched, turn, deep = member, None, None, 0, []
    while True:
        roots = [F.xxhash64(F.lit(i), F.slice("t", ROOT * i + 1, ROOT)) for i in range(TREES)]
        first = active.select(F.explode(F.array(*roots)).alias("node"), "s")
        shared = first.groupBy("node").agg(F.count("*").alias("k")).filter("k > 1").select("node")
        nodes, level = space.save(first.join(shared, "node"), "nodes"), 0
        while True:
            # odd sketches are for the few pairs below the root, tokens for branching alone
            kinds = active.drop("t", "odd") if level == 0 else active.drop("t")
            rows = nodes.join(_labelled(kinds, labels), "s")
            stats = space.save(_stats(rows), "stats")
            pairs = space.save(_candidates(rows, stats, level, percent), "pairs")
            if fetched is None:
                # full sets of what may link here, and of what may be compared further down
                sets = nodes.join(stats.filter(_large(level)).select("node"), "node").select("s")
                fetched = full(sets.union(pairs.select("a")).union(pairs.select("b")).distinct())
            links = space.save(_confirmed(pairs, fetched, percent), "links")
            labels = _merge(labels, links, space)
            # what pivots have left of the large nodes
            large = nodes.join(stats.filter(_large(level)).select("node"), "node")
            known = _labelled(active.select("s"), labels)
            left = space.save(_stats(large.join(known, "s")).select("node", "rest"), "left")
            space.drop(stats, pairs, links)
            if left.isEmpty():
                space.drop(nodes, left)
                break
            level += 1
            open_ = left.filter(_large(level))
            if (times := _rounds(percent, level)) > turn + 1:
                deep.append((times, space.save(nodes.join(open_.select("node"), "node").select("s").distinct(), "deep")))
            ready = nodes.join(left.filter(~_large(level)).select("node"), "node").select("node", "s")
            grown = _branch(nodes.join(active.select("s", "t"), "s"), open_, percent).select("node", "s")
            lonely = grown.groupBy("node").agg(F.count("*").alias("k")).filter("k > 1").select("node")
            grown = space.save(ready.union(grown.join(lonely, "node")), "nodes")
            space.drop(nodes, left)
            nodes = grown
        turn += 1
        if turn > 1:
            space.drop(active)
        again = [table for times, table in deep if times > turn and not table.isEmpty()]
        if not again:
            space.drop(fetched, *[table for _, table in deep])
            return labels
        active = _renewed(member, reduce(DataFrame.union, again).distinct(), fetched, turn, space)


def _renewed(member: DataFrame, names: DataFrame, full: DataFrame, turn: int, space: Workspace) -> DataFrame:
    """The named sets (column s) with other minwise tokens."""
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, min(500, batch.num_rows - lo))
                sets = part.column(1)
                values = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                counts = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                new = _minwise(values, counts, turn)[0].ravel().view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), ta.lists(new, np.full(len(counts), POSITIONS), pa.int32())], ["s2", "t"]
                )

    sets = full.join(names, F.col("_set") == F.col("s"), "left_semi").select("_set", "_all")
    new = sets.mapInArrow(tokens, "s2 binary, t array<int>")
    return space.save(member.drop("t").join(new, F.col("s") == F.col("s2")).drop("s2"), "renewed")


def _merge(labels: DataFrame | None, links: DataFrame, space: Workspace) -> DataFrame:
    """Labels after links between sets, which join their components."""
    if labels is None:
        edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        one = labels.select(F.col("s").alias("a"), F.col("c").alias("ca"))
        two = labels.select(F.col("s").alias("b"), F.col("c").alias("cb"))
        edges = links.join(one, "a", "left").join(two, "b", "left").select(
            F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v")
        )
    new = components(edges, space).select(F.col("u").alias("s"), F.col("v").alias("c"))
    if labels is None:
        return new
    moved = labels.join(
        new.select(F.col("s").alias("c"), F.col("c").alias("c2")), "c", "left"
    ).select("s", F.coalesce("c2", "c").alias("c"))
    return space.save(moved.union(new.join(labels.select("s"), "s", "left_anti")), "labels")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = True,
    one_row: bool = False, space: Workspace | None = None, percent: int = PERCENT,
) -> DataFrame:
    """Every row with ``n_shingles``, ``component_id`` (the least id of its group) and ``kept``.

    Sets are linked that share ``percent`` of their shingles or more."""
    space = space or Workspace(docs.sparkSession)
    out = ("n_shingles", "component_id", "kept")
    own = [c for c in docs.columns if c not in out and (with_text or c != text)]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)],
        F.col(f"`{key}`").alias("_key"),
        F.monotonically_increasing_id().alias("_row"),
        F.col(f"`{text}`").alias("_text"),
    )
    columns = [f"_c{i}" for i in range(len(own))]
    # texts stay where they are: what is found of a row is a matter of its id and text
    plain = rows.drop(*columns) if with_text else rows
    if with_text:
        plain = plain.select("_key", "_row", _name().alias("_name"), "_text")
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    spec += ", n_shingles long, _set binary, _tokens array<int>, _b0 long, _b1 long, _odd array<long>"
    scratch = Workspace(docs.sparkSession, space.root) if with_text else space
    measured = scratch.save(plain.mapInArrow(_measure, spec), "measured")
    linked = measured.filter("_set is not null and _key is not null")
    sets = scratch.save(
        linked.select("_set", "n_shingles", "_tokens", "_b0", "_b1", "_odd").dropDuplicates(["_set"]), "sets"
    )

    def full(active: DataFrame) -> DataFrame:
        ids = linked.select("_set", "_key").join(active.withColumnRenamed("s", "_set"), "_set", "left_semi")
        ids = ids.groupBy("_set").agg(F.min("_key").alias("_id"))
        ids = ids.groupBy("_id").agg(F.collect_list("_set").alias("_sets"))  # of the texts of one id
        texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
        # each set comes from one id, and repeated rows meet where their id is
        texts = texts.join(ids, F.col("_key") == F.col("_id")).dropDuplicates(["_key", "_text", "_sets"])
        return scratch.save(
            texts.select("_text", "_sets").mapInArrow(_full_sets, "_set binary, _all array<long>"), "full"
        )

    labels = _label(sets, full, scratch, percent)
    scratch.drop(sets)
    # classes with the least id of each, then of each component
    classes = linked.groupBy("_set").agg(F.min("_key").alias("_least"))
    named = classes.join(labels.withColumnsRenamed({"s": "_s", "c": "_c"}), F.expr("_set = _s"), "left")
    named = named.select("_set", F.coalesce("_c", "_set").alias("_c"), "_least")
    least = named.groupBy("_c").agg(F.min("_least").alias("component_id"))
    named = named.join(least, "_c").select(F.col("_set").alias("_s"), "component_id")
    judged = measured.drop("_tokens", "_b0", "_b1", "_odd").join(
        named, (F.col("_set") == F.col("_s")) & F.col("_key").isNotNull(), "left"
    )
    component = F.coalesce("component_id", "_key")
    judged = judged.withColumn("component_id", component).withColumn(
        "kept", F.col("_key").isNull() | (F.col("_key") == F.col("component_id"))
    )
    if one_row:  # repeated rows of the least id meet here, a group's other documents don't
        first = (
            judged.filter("kept").groupBy("_key", "_set").agg(F.min("_row").alias("_first"))
            .groupBy("_key").agg(F.min("_first").alias("_first"))
            .select(F.col("_key").alias("_k"), "_first")
        )
        judged = judged.join(first, F.col("_key") == F.col("_k"), "left").withColumn(
            "kept", F.col("kept") & (F.col("_key").isNull() | (F.col("_row") == F.col("_first")))
        )
    if with_text:
        found = space.save(
            judged.groupBy("_name").agg(
                F.first("n_shingles").alias("n_shingles"), F.first("component_id").alias("component_id"),
                F.max("kept").alias("kept"),
            ).withColumnRenamed("_name", "_found"),
            "found",
        )
        scratch.clear()
        rows = rows.select(*columns, "_key", "_row", _name().alias("_name"))
        judged = rows.join(found, F.col("_name") == F.col("_found"), "left")
        if one_row:  # the least of repeated rows, as above
            least = F.min("_row").over(Window.partitionBy("_name"))
            judged = judged.withColumn("kept", F.col("kept") & (F.col("_key").isNull() | (F.col("_row") == least)))
    return judged.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], *out)


def _name() -> Column:
    """A row's id and the SHA-256 of its text; nulls are equal in it."""
    return F.struct("_key", F.unhex(F.sha2("_text", 256)).alias("hash"))
