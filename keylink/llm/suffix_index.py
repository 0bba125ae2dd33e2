"""Repeated byte strings by anchors counted in levels, and by window hashes.

Suffixes start at anchors (see anchors.py), so a string of ``WINDOW`` bytes that repeats has an anchor
at each of its places, at the same offset. This is no suffix order: a suffix is known by a hash of its
first ``ANCHOR`` bytes only, since windows need equality alone. Documents come in ``BATCHES`` ranges of
ids. A batch's hashes are counted and joined with each existing level, without a shuffle, since all
tables have the same buckets; then they become a level, and levels of equal rank merge, so that each
count is rewritten at most log2(batches) times. Levels hold (hash, count), never suffixes; they find
the beginnings that repeat, as one count over all batches would, and go when the call ends.

Suffixes with a partner are then compared over the whole range that their windows reach. Those with
the same range of bytes as an earlier one repeat whole; the first of each range are compared window
by window within their bucket, or, for a beginning with over ``HOT`` different ranges, by a shuffle
of their windows. Ranges and windows are known by 128 bits of hash.

Defined results: null texts are empty; equal rows of one id are one document, so none of
them is earlier; rows of one id with different texts are documents of their own, in an order by the
hash of their texts; null ids come first; an empty table gives an empty
table. Texts have less than 2^30 bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylink.llm import textarrays as ta
from keylink.llm.anchors import coordinate, one_text_each, union_length, window_anchors
from keylink.sources.workspace import Workspace

WINDOW = 100
ANCHOR = 24
BATCHES = 4
# Pieces of one beginning that a task compares: with their windows about 120 MB.
HOT = 50_000
_RANGES = "_doc long, _anchor long, _range long, _from int, _n int"


def _ranges(c: ta.Chunk):
    """Per anchor of a document: document, first window's start in the chunk, number of windows,
    and the anchor's hash."""
    n = np.maximum(np.diff(c.offsets) - WINDOW + 1, 0)
    doc, at = ta.spread(n)
    start = c.offsets[doc] + at
    if not len(start):
        return doc, start, start, np.zeros(0, dtype=np.uint64)
    values = ta._BYTES[c.data]
    places = np.arange(len(values) - ANCHOR + 1)
    runs = ta.window_hashes(values, places, places + ANCHOR)
    anchor = window_anchors(runs, start, WINDOW - ANCHOR + 1)
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    count = np.diff(np.append(first, len(start)))
    return doc[first], start[first], count, runs[anchor[first]]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in ta.chunks(batch.column(1)):
            doc, start, count, anchor = _ranges(c)
            if not len(doc):
                continue
            whole = ta.window_hashes(ta._BYTES[c.data], start, start + count + WINDOW - 1)
            cols = [
                batch.column(0).take(pa.array(c.lo + doc)), ta.signed(anchor), ta.signed(whole),
                pa.array(start - c.offsets[doc], pa.int32()), pa.array(count, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["_doc", "_anchor", "_range", "_from", "_n"])


class Levels:
    """Suffix arrays in buckets by beginning; a level is one array of rank r."""

    def __init__(self, space: Workspace):
        self.spark, self.space = space.spark, space
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str]] = []
        self.tables: list[str] = []

    def write(self, frame: DataFrame, dealt: bool) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        if not dealt:
            frame = frame.repartition(self.buckets, "_anchor")
        (
            frame.sortWithinPartitions("_anchor").write.format("parquet")
            .bucketBy(self.buckets, "_anchor").sortBy("_anchor")
            .option("path", f"{self.space.root}/{name}").saveAsTable(name)
        )
        self.tables.append(name)
        return name

    def add(self, run: str) -> DataFrame:
        """Adds a batch's array; returns the beginnings that it has twice or shares with a level."""
        counts = self.spark.table(run).groupBy("_anchor").agg(F.count("*").alias("n"))
        own = self.write(counts, dealt=True)
        mine = self.spark.table(own)
        found = [mine.filter("n > 1").select("_anchor")]
        found += [mine.join(self.spark.table(t), "_anchor").select("_anchor") for _, t in self.levels]
        hits = self.space.save(reduce(DataFrame.union, found).distinct(), "hits")
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, other = self.levels.pop()
            a, b = self.spark.table(own), self.spark.table(other).withColumnsRenamed({"_anchor": "o", "n": "m"})
            both = a.join(b, F.col("_anchor") == F.col("o"), "full_outer").select(
                F.coalesce("_anchor", "o").alias("_anchor"),
                (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"),
            )
            merged = self.write(both, dealt=True)
            for old in (own, other):
                self.forget(old)
            own, rank = merged, rank + 1
        self.levels.append((rank, own))
        return hits

    def forget(self, name: str) -> None:
        """Drops a table of this family and its files, which no later step reads."""
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.space.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.tables.remove(name)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the ranges that are listed for each text."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for row, (text, spans) in enumerate(zip(texts, batch.column(2).to_pylist(), strict=True)):
            raw = (text or "").encode()
            spans = [s for s in spans if s["_from"] + s["_n"] + WINDOW - 1 <= len(raw)]
            parts = [raw[s["_from"] : s["_from"] + s["_n"] + WINDOW - 1] for s in spans]
            for lo in range(0, len(spans), 5000):
                some = spans[lo : lo + 5000]
                cols = [
                    pa.array([batch.column(0)[row].as_py()] * len(some), pa.int64()),
                    pa.array([s["_anchor"] for s in some], pa.int64()),
                    pa.array([s["_from"] for s in some], pa.int32()),
                    pa.array([s["_n"] for s in some], pa.int32()),
                    pa.array(parts[lo : lo + 5000], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["_doc", "_anchor", "_from", "_n", "_bytes"])


def _window_table(data: list[bytes], counts: np.ndarray):
    """(piece, place in it, hash) of every window of the pieces."""
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    begin = np.cumsum(counts + WINDOW - 1) - (counts + WINDOW - 1)
    piece, at = ta.spread(counts)
    start = begin[piece] + at
    return piece, at, ta.window_hashes(ta._BYTES[flat], start, start + WINDOW)


_SPANS = "_doc long, _from int, _n int"


def _repeats_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that an earlier piece of the same beginning has too. Pieces come sorted by
    beginning, with at most HOT of one."""
    rest = None
    for batch in _with_end(batches):
        if batch is not None:
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            keys = rest.column("_anchor").to_numpy()
            if rest.num_rows < 2000:
                continue
            stop = int(np.searchsorted(keys, keys[-1]))
        elif rest is None:
            return
        else:
            stop = rest.num_rows
        if stop == 0:
            continue
        part, rest = rest.slice(0, stop), rest.slice(stop)
        for lo, hi in _cuts(part.column("_anchor").to_numpy()):
            yield _first_windows(part.slice(lo, hi - lo))


def _with_end(batches):
    yield from batches
    yield None


def _cuts(keys: np.ndarray, rows: int = 4000) -> Iterator[tuple[int, int]]:
    """Slices of about so many rows that don't cut a key."""
    lo = 0
    while lo < len(keys):
        hi = lo + rows
        hi = len(keys) if hi >= len(keys) else int(np.searchsorted(keys, keys[hi], "right"))
        yield lo, hi
        lo = hi


def _first_windows(table: pa.Table) -> pa.RecordBatch:
    table = table.combine_chunks()
    counts = table.column("_n").to_numpy().astype(np.int64)
    doc = table.column("_doc").to_numpy(zero_copy_only=False)
    begin = table.column("_from").to_numpy().astype(np.int64)
    piece, at, h = _window_table(table.column("_bytes").to_pylist(), counts)
    key = table.column("_anchor").to_numpy()[piece]
    order = np.lexsort((begin[piece] + at, doc[piece], h, key))
    k, x, d, s = key[order], h[order], doc[piece][order], (begin[piece] + at)[order]
    group = np.cumsum(np.append(0, (k[1:] != k[:-1]) | (x[1:] != x[:-1])))
    first = np.searchsorted(group, group)
    later = (d != d[first]) | (s != s[first])
    again = np.zeros(len(order), dtype=bool)
    again[order] = later
    return _runs(piece[again], at[again], doc, begin)


def _runs(piece: np.ndarray, at: np.ndarray, doc: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
    if not len(piece):
        empty = [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32())]
        return pa.RecordBatch.from_arrays(empty, ["_doc", "_from", "_n"])
    new = np.append(True, (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(piece)))
    cols = [
        pa.array(doc[piece[first]], pa.int64()),
        pa.array(begin[piece[first]] + at[first], pa.int32()),
        pa.array(count, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(cols, ["_doc", "_from", "_n"])


def _explode_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            counts = part.column(3).to_numpy().astype(np.int64)
            piece, at, h = _window_table(part.column(4).to_pylist(), counts)
            rows = pa.array(piece)
            place = part.column(2).to_numpy().astype(np.int64)[piece] + at
            cols = [part.column(0).take(rows), part.column(1).take(rows), pa.array(place, pa.int32()), ta.signed(h)]
            yield pa.RecordBatch.from_arrays(cols, ["_doc", "_anchor", "_from", "_h"])


def repeated_windows(docs: DataFrame, key: str, text: str, space: Workspace) -> DataFrame:
    """_doc, _from, _n: runs of windows (by their starts) that occur earlier."""
    spark = docs.sparkSession
    plain = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))).alias("_doc"),
        F.col(f"`{text}`").alias("_text"),
    )
    shares = [i / BATCHES for i in range(1, BATCHES)]
    bounds = sorted(set(plain.agg(F.percentile_approx("_doc", shares, 10_000)).first()[0] or []))
    family, runs, hits = Levels(space), [], []
    for lo, hi in zip([None, *bounds], [*bounds, None], strict=True):
        batch = plain
        if lo is not None:
            batch = batch.filter(F.col("_doc") > lo)
        if hi is not None:
            batch = batch.filter(F.col("_doc") <= hi)
        runs.append(family.write(batch.mapInArrow(_suffixes, _RANGES), dealt=False))
        hits.append(family.add(runs[-1]))
    hit = space.save(reduce(DataFrame.union, hits).distinct().repartition(family.buckets, "_anchor"), "hit")
    found = [spark.table(r).join(hit, "_anchor", "left_semi") for r in runs]
    suffixes = space.save(reduce(DataFrame.union, found), "suffixes")
    for name in list(family.tables):
        family.forget(name)
    at = coordinate(F.col("_doc"), F.col("_from"))
    ranges = space.save(
        suffixes.groupBy("_anchor", "_range", "_n").agg(F.min(at).alias("f"), F.count("*").alias("k")),
        "ranges",
    )
    copies = (
        suffixes.join(ranges.filter("k > 1"), ["_anchor", "_range", "_n"])
        .filter(at != F.col("f")).select("_doc", "_from", "_n")
    )
    several = ranges.groupBy("_anchor").agg(F.count("*").alias("c")).filter("c > 1")
    unit = F.lit(1 << 30).cast("decimal(20,0)")
    firsts = ranges.join(several, "_anchor").withColumn("d", F.floor(F.col("f") / unit)).select(
        "_anchor", "_n", "c", F.col("d").cast("long").alias("_doc"),
        (F.col("f") - F.col("d") * unit).cast("int").alias("_from"),
    )
    wanted = firsts.groupBy("_doc").agg(F.collect_set(F.struct("_anchor", "_from", "_n")).alias("_list"))
    pieces = (
        plain.join(wanted, "_doc").select("_doc", "_text", "_list")
        .mapInArrow(_pieces, "_doc long, _anchor long, _from int, _n int, _bytes binary")
    )
    pieces = space.save(pieces, "pieces").join(several, "_anchor")
    shape = ["_doc", "_anchor", "_from", "_n", "_bytes"]
    cold = (
        pieces.filter(F.col("c") <= HOT).select(shape)
        .repartition("_anchor").sortWithinPartitions("_anchor")
        .mapInArrow(_repeats_in_buckets, _SPANS)
    )
    windows = pieces.filter(F.col("c") > HOT).select(shape).mapInArrow(
        _explode_windows, "_doc long, _anchor long, _from int, _h long"
    )
    windows = windows.withColumn("w", coordinate(F.col("_doc"), F.col("_from")))
    least = windows.groupBy("_anchor", "_h").agg(F.min("w").alias("f"))
    hot = windows.join(least, ["_anchor", "_h"]).filter("w > f").select(
        "_doc", "_from", F.lit(1).alias("_n")
    )
    return copies.union(cold).union(hot)


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.num_columns - 3
            rows: list[list] = [[], [], [], [], []]
            for text, begin, n in zip(*(batch.column(own + i) for i in range(3)), strict=True):
                raw = (text.as_py() or "").encode()
                left, removed, spans = raw, 0, 0
                if begin.as_py():
                    at = np.array(begin.as_py(), dtype=np.int64)
                    gone = union_length(at, at + np.array(n.as_py()) + WINDOW - 1, len(raw))
                    left = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                    removed = int(gone.sum())
                    spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                for to, x in zip(rows, (len(raw), removed, spans, hashlib.sha256(left).hexdigest(), left), strict=True):
                    to.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]
            m = 5 if with_text else 4
            cols = [batch.column(i) for i in range(own)]
            cols += [pa.array(x, t) for x, t in zip(rows[:m], kinds[:m], strict=True)]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:own], *names[:m]])

    return run


def drop_repeated_bytes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True
) -> DataFrame:
    """Every row with n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept_bytes (which may
    cut a character)."""
    space = Workspace(docs.sparkSession)
    out = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_bytes"] * with_text
    own = [c for c in docs.columns if c not in out and c != text]
    docs, key = one_text_each(docs, key, text, space)
    spans = repeated_windows(docs, key, text, space).groupBy("_doc").agg(
        F.collect_list(F.struct("_from", "_n")).alias("_spans")  # one document's
    )
    plain = docs.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)],
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))).alias("_doc"),
        F.col(f"`{text}`").alias("_text"),
    )
    joined = plain.join(spans, "_doc", "left").select(
        *[f"_c{i}" for i in range(len(own))], "_text",
        F.col("_spans._from").alias("_from"), F.col("_spans._n").alias("_n"),
    )
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-3])
    spec += ", n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    spec += ", kept_bytes binary" * with_text
    done = joined.mapInArrow(_cut(with_text), spec)
    return done.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], *out)
