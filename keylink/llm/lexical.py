"""Ranked lexical search over norm buckets.

A document is a vector of term impacts, an item a vector of term weights, the score their product.
Only terms of the items asked for matter, so a document's vector has these alone. Both sides carry
the root of the term weight, which keeps lengths meaningful: a long vector has many or rare terms.

Vectors are written in order of falling length with the number of their bucket, a span of lengths of
``RATIO``, and searched bucket by bucket from the longest on. Against the best ``top`` scores an item
has so far, in this task or in the waves of buckets before, a bucket is left out for it where
Cauchy-Schwarz (length of the item times greatest length in the bucket) can't reach them. Inside a
bucket the item's ``FOCUS`` heaviest coordinates are multiplied out, and Cauchy-Schwarz bounds the
others by what is left of both lengths; documents that still reach the tenth score are scored
exactly in 64-bit integers. Bounds are rounded up, and only scores strictly below the tenth are
pruned, so the result equals that of scoring everything.

Items are taken in blocks of at most ``BLOCK_TERMS`` terms, the only thing sent to tasks; texts are
read once for their terms in each block, and never shuffled. A task returns at most ``top`` rows for
each item of the block.

Defined results: null or empty texts have no terms, count nowhere and are in no result; items
without terms give no rows; a null doc_id ranks behind others of its score; repeated documents and
repeated items are each their own; fewer than ``top`` documents with a score give fewer rows; an
empty table on either side gives an empty table; other columns of the tables aren't read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from keylink.functions.frames import union_all
from keylink.llm import textarrays as ta
from keylink.sources.workspace import Workspace

TERM = np.isin(
    np.arange(256), list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
) | (np.arange(256) >= 128)
RATIO = 0.9
# Neighbouring buckets of a batch are searched as one until they have this many vectors.
BUCKET_ROWS = 512
FOCUS = 3
BLOCK_TERMS = 200_000
# Shares of the documents that are searched before the rest, longest vectors first.
WAVES = (1 / 64, 1 / 8)
RESULT = "item_id {id}, rank int, doc_id {doc}, score long"


def term_bounds(c: ta.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of every term of a chunk."""
    n = len(c.data)
    inside = TERM[c.data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[c.offsets] = True
    before, after = cut[:n].copy(), cut[1:].copy()
    before[1:] |= ~inside[:-1]
    after[:-1] |= ~inside[1:]
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def _term_hashes(c: ta.Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of every term, as rows."""
    lowered = ta._BYTES[ta.LOWER[c.data]]
    return np.stack([ta.window_hashes(lowered, starts, ends, which) for which in (0, 1)], axis=1)


@dataclass(frozen=True)
class Vocabulary:
    """Terms of a block of items as sorted pairs of hashes; a term's place is its number."""

    first: np.ndarray
    second: np.ndarray

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term, -1 for one that isn't in the block."""
        if not len(self.first):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.first, hashes[:, 0]), len(self.first) - 1)
        found = (self.first[at] == hashes[:, 0]) & (self.second[at] == hashes[:, 1])
        return np.where(found, at, -1)


def _item_terms(batches) -> Iterator[pa.RecordBatch]:
    """Items as lists of their terms' hashes, repeats included."""
    for batch in batches:
        for c in ta.chunks(batch.column(1)):
            starts, ends = term_bounds(c)
            hashes = _term_hashes(c, starts, ends)
            counts = np.diff(np.searchsorted(starts, c.offsets))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[c.lo : c.hi],
                    ta.lists(hashes[:, 0].copy(), counts, pa.int64()),
                    ta.lists(hashes[:, 1].copy(), counts, pa.int64()),
                ],
                ["_item", "_h0", "_h1"],
            )


def _doc_terms(batches, words: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Number of terms of each document, and its terms of the block with their frequencies."""
    size = max(len(words.first), 1)
    for batch in batches:
        for c in ta.chunks(batch.column(1)):
            docs = c.hi - c.lo
            starts, ends = term_bounds(c)
            bounds = np.searchsorted(starts, c.offsets)
            number = words.numbers(_term_hashes(c, starts, ends))
            doc = np.repeat(np.arange(docs), np.diff(bounds))
            pairs, tf = np.unique((doc * size + number)[number >= 0], return_counts=True)
            counts = np.bincount(pairs // size, minlength=docs)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[c.lo : c.hi],
                    pa.array(np.diff(bounds), pa.int64()),
                    ta.lists((pairs % size).astype(np.int32), counts, pa.int32()),
                    ta.lists(tf.astype(np.int64), counts, pa.int64()),
                ],
                ["_doc", "_n", "_t", "_tf"],
            )


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Whole-number impact of a term that occurs ``tf`` times in a document of ``n`` terms."""
    m = 100 - 75 + (75 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def term_weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _vectors(batches, n_docs: int, n_terms: int, roots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Impacts in place of frequencies, with the length of the vector and its bucket."""
    for batch in batches:
        count = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        term = np.asarray(batch.column(2).flatten())
        tf = np.asarray(batch.column(3).flatten())
        n = np.repeat(batch.column(1).to_numpy(), count)
        value = impact(tf, n, n_docs, n_terms)
        square = np.bincount(
            np.repeat(np.arange(batch.num_rows), count), (roots[term] * value) ** 2, batch.num_rows
        )
        length = np.sqrt(square)
        bucket = np.floor(np.log(np.maximum(length, 1.0)) / -math.log(RATIO)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(bucket), pa.array(length),
                batch.column(2), ta.lists(value, count, pa.int64()),
            ],
            ["_doc", "_bucket", "_length", "_t", "_v"],
        )


@dataclass(frozen=True)
class Query:
    """One item: its terms from the heaviest on, exact weights, rooted weights and lengths."""

    terms: np.ndarray
    weights: np.ndarray
    rooted: np.ndarray
    length: float
    rest: float


def make_query(numbers: np.ndarray, weights: np.ndarray, roots: np.ndarray) -> Query:
    terms, repeats = np.unique(numbers, return_counts=True)
    order = np.argsort(-(repeats * roots[terms]), kind="stable")
    terms, repeats = terms[order], repeats[order]
    rooted = repeats * roots[terms]
    return Query(
        terms, repeats * weights[terms], rooted, float(np.sqrt((rooted**2).sum())),
        float(np.sqrt((rooted[FOCUS:] ** 2).sum())),
    )


class _Best:
    """The ``top`` best (score, document) of an item; a null document is the last of its score."""

    def __init__(self, top: int, known: int):
        self.top, self.known, self.heap = top, known, []

    def floor(self) -> int:
        """Documents with a lower score can't be among the best."""
        return max(self.known, self.heap[0][0] if len(self.heap) == self.top else 1)

    def offer(self, scores, docs) -> None:
        for score, doc in zip(scores, docs, strict=True):
            entry = (score, doc is not None, -doc if doc is not None else 0, doc)
            if len(self.heap) < self.top:
                heapq.heappush(self.heap, entry)
            elif entry[:3] > self.heap[0][:3]:
                heapq.heapreplace(self.heap, entry)


class Bucket:
    """Vectors of one bucket as postings: for each term the documents that have it."""

    def __init__(self, docs: list, length: np.ndarray, count, term, value, roots: np.ndarray):
        self.docs, self.length = docs, length
        order = np.argsort(term, kind="stable")
        self.owner = np.repeat(np.arange(len(length)), count)[order]
        self.term, self.value = term[order], value[order]
        self.rooted = roots[self.term] * self.value
        self.longest = float(length.max())

    def postings(self, terms: np.ndarray) -> list[slice]:
        ends = np.searchsorted(self.term, np.stack([terms, terms + 1])).tolist()
        return [slice(lo, hi) for lo, hi in zip(*ends, strict=True)]

    def search(self, q: Query, best: _Best, counts: np.ndarray) -> None:
        slack = 1 + 1e-9
        floor = best.floor()
        if q.length * self.longest * slack < floor:
            return
        found = np.zeros(len(self.length))
        square = np.zeros(len(self.length))
        listed = self.postings(q.terms)
        for at, weight in zip(listed, q.rooted[:FOCUS].tolist()):
            found[self.owner[at]] += weight * self.rooted[at]
            square[self.owner[at]] += self.rooted[at] ** 2
        # What rounding may take from the difference of squares is added again.
        others = np.sqrt(np.maximum(self.length**2 * slack - square, 0.0))
        alive = (found + q.rest * others) * slack >= floor
        counts[1] += int(alive.sum())
        score = np.zeros(len(self.length), dtype=np.int64)
        for at, weight in zip(listed, q.weights.tolist(), strict=True):
            owner, value = self.owner[at], self.value[at]
            live = alive[owner]
            score[owner[live]] += weight * value[live]
        chosen = np.flatnonzero(score >= floor)
        if len(chosen) > 4 * best.top:
            # Keep all documents that tie with the last of the best ones.
            least = np.partition(score[chosen], -best.top)[-best.top]
            chosen = chosen[score[chosen] >= least]
        best.offer(score[chosen].tolist(), [self.docs[i] for i in chosen.tolist()])


def _buckets(batch: pa.RecordBatch, roots: np.ndarray) -> Iterator[Bucket]:
    bucket = batch.column(1).to_numpy()
    ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket)).tolist()
    lo = 0
    for hi in ends:
        if hi == lo or (hi - lo < BUCKET_ROWS and hi < len(bucket)):
            continue
        part = batch.slice(lo, hi - lo)
        yield Bucket(
            part.column(0).to_pylist(),
            part.column(2).to_numpy(),
            part.column(3).value_lengths().to_numpy(zero_copy_only=False),
            np.asarray(part.column(3).flatten()),
            np.asarray(part.column(4).flatten()),
            roots,
        )
        lo = hi


def _search(batches, queries, known, roots, top: int, doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A task's best documents of each item, and how many documents its bounds let through."""
    best = [_Best(top, floor) for floor in known]
    counts = np.zeros(2, dtype=np.int64)
    for batch in batches:
        for bucket in _buckets(batch, roots):
            counts[0] += len(bucket.docs)
            for q, b in zip(queries, best, strict=True):
                bucket.search(q, b, counts)
    rows = [(i, e[3], e[0]) for i, b in enumerate(best) for e in b.heap]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([r[1] for r in rows], doc_type),
            pa.array([r[2] for r in rows], pa.int64()),
        ],
        ["_q", "_doc", "_score"],
    )


def _blocks(items: DataFrame) -> Iterator[list]:
    """Items (id, hashes) in blocks; no more than one block is on the driver at a time."""
    block, size = [], 0
    for row in items.toLocalIterator(prefetchPartitions=False):
        if not row["_h0"]:
            continue
        if block and size + len(row["_h0"]) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((row["_item"], np.array(row["_h0"]), np.array(row["_h1"])))
        size += len(row["_h0"])
    if block:
        yield block


def _best_of(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("_q").orderBy(F.desc("_score"), F.asc_nulls_last("_doc"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _search_block(docs: DataFrame, block: list, top: int, space: Workspace) -> DataFrame | None:
    """(_q, rank, _doc, _score) of a block of items; None where no document has terms."""
    pairs = np.unique(
        np.stack([np.concatenate([b[i] for b in block]).astype(np.int64) for i in (1, 2)], axis=1)
        .view(np.uint64), axis=0,
    )
    words = Vocabulary(pairs[:, 0].copy(), pairs[:, 1].copy())
    doc_type = docs.schema["_doc"].dataType
    kind = doc_type.simpleString()
    counted = space.save(
        docs.mapInArrow(
            partial(_doc_terms, words=words), f"_doc {kind}, _n long, _t array<int>, _tf array<long>"
        ),
        "terms",
    )
    total = counted.filter("_n > 0").agg(F.count("*"), F.sum("_n")).first()
    n_docs, n_terms = int(total[0]), int(total[1] or 0)
    if not n_docs:
        space.drop(counted)
        return None
    df = {
        row["_term"]: row["_df"]
        for row in counted.select(F.explode("_t").alias("_term")).groupBy("_term")
        .agg(F.count("*").alias("_df")).collect()
    }
    weights = np.array([term_weight(df.get(t, 0), n_docs) for t in range(len(words.first))], dtype=np.int64)
    roots = np.sqrt(weights.astype(np.float64))
    queries = [
        make_query(
            words.numbers(np.stack([h0, h1], axis=1).astype(np.int64).view(np.uint64)), weights, roots
        )
        for _, h0, h1 in block
    ]
    vectors = space.save(
        counted.filter(F.size("_t") > 0).mapInArrow(
            partial(_vectors, n_docs=n_docs, n_terms=n_terms, roots=roots),
            f"_doc {kind}, _bucket int, _length double, _t array<int>, _v array<long>",
        ).sortWithinPartitions(F.desc("_bucket"), F.desc("_length")),
        "vectors",
    )
    space.drop(counted)
    spread = vectors.groupBy("_bucket").agg(F.count("*").alias("_k")).orderBy(F.desc("_bucket")).collect()
    found: list[DataFrame] = []
    floors = [1] * len(queries)
    for high, low in _waves([(row["_bucket"], row["_k"]) for row in spread]):
        part = vectors.filter(F.col("_bucket").between(low, high))
        run = partial(
            _search, queries=queries, known=floors, roots=roots, top=top,
            doc_type=to_arrow_type(doc_type),
        )
        rows = part.mapInArrow(run, f"_q int, _doc {kind}, _score long")
        found.append(space.save(_best_of(rows, top).select("_q", "_doc", "_score"), "found"))
        last = (
            _best_of(union_all(found), top).filter(F.col("rank") == top).select("_q", "_score").collect()
        )
        for row in last:
            floors[row["_q"]] = max(floors[row["_q"]], row["_score"])
    space.drop(vectors)
    if not found:
        return None
    return _best_of(union_all(found), top).select("_q", "rank", "_doc", "_score")


def _waves(buckets: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(highest, lowest) bucket of each wave, longest vectors first."""
    total = sum(count for _, count in buckets)
    limits = [share * total for share in WAVES]
    waves, seen, high = [], 0, None
    for bucket, count in buckets:
        high = bucket if high is None else high
        seen += count
        if limits and seen >= limits[0]:
            waves.append((high, bucket))
            limits = [limit for limit in limits if limit > seen]
            high = None
    if high is not None:
        waves.append((high, buckets[-1][0]))
    return waves


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = 10,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    space: Workspace | None = None,
) -> DataFrame:
    """The ``top`` highest-scoring documents of each item: item_id, rank, doc_id, score."""
    space = space or Workspace(docs.sparkSession)
    spark = docs.sparkSession
    plain = docs.select(F.col(f"`{id_column}`").alias("_doc"), F.col(f"`{text}`").alias("_text"))
    asked = items.select(F.col(f"`{item_id}`").alias("_item"), F.col(f"`{item_text}`").alias("_text"))
    item_kind = asked.schema["_item"].dataType.simpleString()
    listed = space.save(
        asked.mapInArrow(_item_terms, f"_item {item_kind}, _h0 array<long>, _h1 array<long>"), "items"
    )
    results = []
    for block in _blocks(listed):
        best = _search_block(plain, block, top, space)
        if best is not None:
            names = spark.createDataFrame(
                [(q, entry[0]) for q, entry in enumerate(block)], f"_q int, item_id {item_kind}"
            )
            results.append(
                best.join(names, "_q").select(
                    "item_id", "rank", F.col("_doc").alias("doc_id"), F.col("_score").alias("score")
                )
            )
    if results:
        return union_all(results)
    kinds = RESULT.format(id=item_kind, doc=plain.schema["_doc"].dataType.simpleString())
    return spark.createDataFrame([], kinds)
