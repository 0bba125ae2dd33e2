"""Repeated spans of words by compaction of a de Bruijn graph.

Edges are the windows of ``WINDOW`` consecutive words, from their first words to their last. Only
windows whose anchor occurs twice can repeat; all others never leave the scan. Consecutive windows
with one anchor are a run, which is counted as one and keeps its first coordinate (document, start):
at all its later coordinates each of its windows has occurred before. Runs that differ but share an
anchor may share windows as well, so the first occurrence of each is taken apart into its windows,
and these are counted in turn. A run or window continues another if each always follows the other,
as often, and at the next coordinate; a join finds these, and paths of them compact to one span with
its source coordinate. The joins of the paths' first edges back to their occurrences then give every
repeated span with its source. Runs and windows are known by 128 bits of hash.

Defined results: null and wordless texts have no words and lose none; equal rows of one id are one
document, so none of them is earlier; rows of one id with different texts are documents of their own,
in an order by the hash of their texts; null ids come first; an empty table gives an empty table.
Texts have up to 2^30 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keylink.llm import textarrays as ta
from keylink.llm.anchors import (
    LEAST_ID,
    POSITION_BITS,
    coordinate,
    one_text_each,
    union_length,
    window_anchors,
)
from keylink.sources.workspace import Workspace

WINDOW = 20
ANCHOR = 8


def _windows(c: ta.Chunk):
    """Per window of the chunk: document, start in it, anchor's hash, two hashes."""
    hashes = c.word_hashes()
    n = np.maximum(np.diff(c.first_word) - WINDOW + 1, 0)
    doc, at = ta.spread(n)
    start = c.first_word[doc] + at
    runs = np.arange(max(len(hashes) - ANCHOR + 1, 0))
    runs = ta.window_hashes(hashes, runs, runs + ANCHOR)
    anchor = window_anchors(runs, start, WINDOW - ANCHOR + 1)
    return hashes, doc, at, start, anchor, runs


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in ta.chunks(batch.column(1)):
            _, doc, _, _, anchor, runs = _windows(c)
            if not len(anchor):
                continue
            new = _first_of_runs(doc, anchor)
            ids = batch.column(0).take(pa.array(c.lo + doc[new]))
            yield pa.RecordBatch.from_arrays([ids, ta.signed(runs[anchor[new]])], ["_doc", "_anchor"])


def _in_list(values: pa.Array, doc: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether the document's list has the value, for each (document, value)."""
    tag = lambda d, h: ta.mix(h + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sizes = np.asarray(values.value_lengths())
    listed = np.asarray(values.flatten()).view(np.uint64)
    return np.isin(tag(doc, own), tag(np.repeat(np.arange(len(sizes)), sizes), listed))


def _first_of_runs(doc: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))


def _neighbours(h: np.ndarray, group: np.ndarray, keep: np.ndarray) -> list[pa.Array]:
    """What comes before and after the kept items in their group; null at its ends."""
    first = np.append(True, group[1:] != group[:-1])
    last = np.append(group[1:] != group[:-1], True)
    before, after = np.roll(h, 1), np.roll(h, -1)
    return [
        pa.array(before.view(np.int64)[keep], mask=first[keep]),
        pa.array(after.view(np.int64)[keep], mask=last[keep]),
    ]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of windows whose anchor is in their document's list."""
    names = ["_doc", "_at", "_k", "_anchor", "_h", "_g", "_before", "_after"]
    for batch in batches:
        for c in ta.chunks(batch.column(1)):
            hashes, doc, at, start, anchor, runs = _windows(c)
            if not len(anchor):
                continue
            lo = _first_of_runs(doc, anchor)
            size = np.diff(np.append(lo, len(doc)))
            keep = _in_list(batch.column(2)[c.lo : c.hi], doc[lo], runs[anchor[lo]])
            if not keep.any():
                continue
            h, g = (ta.window_hashes(hashes, start[lo], start[lo] + size - 1 + WINDOW, i) for i in range(2))
            cols = [
                batch.column(0).take(pa.array(c.lo + doc[lo][keep])), pa.array(at[lo][keep], pa.int32()),
                pa.array(size[keep], pa.int32()), ta.signed(runs[anchor[lo]][keep]),
                ta.signed(h[keep]), ta.signed(g[keep]), *_neighbours(h, doc[lo], keep),
            ]
            yield pa.RecordBatch.from_arrays(cols, names)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the runs whose place is in their document's list."""
    names = ["_doc", "_at", "_k", "_h", "_g", "_before", "_after"]
    for batch in batches:
        for c in ta.chunks(batch.column(1)):
            hashes, doc, at, start, anchor, _ = _windows(c)
            if not len(anchor):
                continue
            lo = _first_of_runs(doc, anchor)
            run = np.repeat(np.arange(len(lo)), np.diff(np.append(lo, len(doc))))
            kept = _in_list(batch.column(2)[c.lo : c.hi], doc[lo], at[lo].astype(np.uint64))
            keep = kept[run]
            if not keep.any():
                continue
            h, g = (ta.window_hashes(hashes, start, start + WINDOW, i) for i in range(2))
            cols = [
                batch.column(0).take(pa.array(c.lo + doc[keep])), pa.array(at[keep], pa.int32()),
                pa.array(np.ones(int(keep.sum()), dtype=np.int32)),
                # a run that was left out may lie beside this one, so paths end with it
                ta.signed(h[keep]), ta.signed(g[keep]), *_neighbours(h, run, keep),
            ]
            yield pa.RecordBatch.from_arrays(cols, names)


def _unit() -> Column:
    return F.lit(1 << POSITION_BITS).cast("decimal(20,0)")


def _counted(items: DataFrame, *more: str) -> DataFrame:
    """Distinct runs or windows: how often (n), first coordinate (f), and what always is before and after."""
    return (
        items.groupBy("_h", "_g", *more).agg(
            F.count("*").alias("n"), F.min(coordinate(F.col("_doc"), F.col("_at"))).alias("f"),
            F.max("_k").alias("k"),
            F.count("_before").alias("nb"), F.min("_before").alias("b"), F.max("_before").alias("b2"),
            F.count("_after").alias("na"), F.min("_after").alias("a"), F.max("_after").alias("a2"),
        )
        .select(
            "_h", "_g", *more, "n", "f", "k",
            F.when(F.expr("nb = n and b = b2"), F.col("b")).alias("b"),
            F.when(F.expr("na = n and a = a2"), F.col("a")).alias("a"),
        )
    )


def _spans(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Later occurrences of the paths of ``edges``, found by their first edges among ``items``."""
    before = edges.select(
        F.col("_h").alias("h1"), F.col("a").alias("a1"), F.col("n").alias("n1"),
        (F.col("f") + F.col("k")).alias("f1"),
    ).filter("a1 is not null")
    joined = edges.join(
        before,
        (F.col("b") == F.col("h1")) & (F.col("_h") == F.col("a1")) & (F.col("n") == F.col("n1"))
        & (F.col("f") == F.col("f1")),
        "left",
    ).select("_h", "_g", "k", "f", F.col("h1").isNull().alias("head"))
    # The edges of a path have their first coordinates in a row, in one document.
    joined = joined.withColumn("source", F.floor(F.col("f") / _unit()))
    w = Window.partitionBy("source").orderBy("f")
    paths = (
        joined.withColumn("path", F.sum(F.col("head").cast("int")).over(w))
        .groupBy("source", "path")
        .agg(
            F.sum("k").alias("len"), F.min("f").alias("f"),
            F.max(F.when(F.col("head"), F.col("_h"))).alias("_h"),
            F.max(F.when(F.col("head"), F.col("_g"))).alias("_g"),
        )
    )
    at = coordinate(F.col("_doc"), F.col("_at"))
    return items.select("_doc", "_at", "_h", "_g").join(paths, ["_h", "_g"]).filter(at != F.col("f")).select(
        "_doc", "_at", (F.col("len") + WINDOW - 1).cast("int").alias("_words"),
        F.col("source").cast("long").alias("_source"),
        (F.col("f") - F.col("source") * _unit()).cast("int").alias("_source_at"),
    )


def repeated_spans(docs: DataFrame, key: str, text: str, space: Workspace) -> DataFrame:
    """_doc, _at, _words, _source, _source_at: each repeated span with its first occurrence."""
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("_doc"), F.col(f"`{text}`").alias("_text"))
    anchors = space.save(plain.mapInArrow(_anchors, "_doc long, _anchor long"), "anchors")
    twice = anchors.groupBy("_anchor").agg(F.count("*").alias("n")).filter("n > 1").select("_anchor")
    hit = (
        anchors.join(twice, "_anchor").groupBy("_doc").agg(F.collect_set("_anchor").alias("_list"))
        .withColumnRenamed("_doc", "_d")
    )
    hit = space.save(hit, "hit")
    space.drop(anchors)
    runs = space.save(
        plain.join(hit, F.col("_doc").eqNullSafe(F.col("_d"))).select("_doc", "_text", "_list").mapInArrow(
            _runs, "_doc long, _at int, _k int, _anchor long, _h long, _g long, _before long, _after long"
        ),
        "runs",
    )
    space.drop(hit)
    counted = space.save(_counted(runs, "_anchor"), "counted")
    shared = counted.groupBy("_anchor").agg(F.count("*").alias("m")).filter("m > 1").select(
        F.col("_anchor").alias("_shared")
    )
    told = space.save(
        counted.join(shared, F.col("_anchor") == F.col("_shared"), "left")
        .filter("n > 1 or _shared is not null")
        .withColumn("apart", F.col("_shared").isNotNull()).drop("_anchor", "_shared"),
        "told",
    )
    space.drop(counted)
    first = F.floor(F.col("f") / _unit())
    places = (
        told.filter("apart").select(
            first.cast("long").alias("_d"), (F.col("f") - first * _unit()).cast("long").alias("_p")
        )
        .groupBy("_d").agg(F.collect_set("_p").alias("_list"))
    )
    windows = space.save(
        plain.join(places, F.coalesce("_doc", F.lit(LEAST_ID)) == F.col("_d")).select("_doc", "_text", "_list")
        .mapInArrow(_edges, "_doc long, _at int, _k int, _h long, _g long, _before long, _after long"),
        "windows",
    )
    whole = told.filter("n > 1").withColumns(
        {x: F.when(~F.col("apart"), F.col(x)) for x in ("b", "a")}
    )
    edges = space.save(_counted(windows).filter("n > 1"), "edges")
    spans = space.save(_spans(runs, whole).union(_spans(windows, edges)), "spans")
    space.drop(runs, told, windows, edges)
    return spans


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.num_columns - 3
            texts, ats, sizes = (batch.column(own + i) for i in range(3))
            for c in ta.chunks(texts):
                starts, ends = c.word_bounds
                total, removed, digests, clean = [], [], [], []
                raw = c.data.tobytes()
                for i in range(c.hi - c.lo):
                    lo, hi = c.first_word[i], c.first_word[i + 1]
                    span, size = ats[c.lo + i].as_py() or [], sizes[c.lo + i].as_py() or []
                    at = np.array(span, dtype=np.int64)
                    gone = union_length(at, at + np.array(size, dtype=np.int64), int(hi - lo))
                    left = lo + np.flatnonzero(~gone)
                    text = b" ".join(
                        raw[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True)
                    )
                    total.append(int(hi - lo))
                    removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(text).hexdigest())
                    clean.append(text.decode())
                cols = [batch.column(i)[c.lo : c.hi] for i in range(own)]
                cols += [pa.array(x, pa.int64()) for x in (total, removed)] + [pa.array(digests, pa.string())]
                names = [*batch.schema.names[:own], "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols.append(pa.array(clean, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def drop_repeated_words(
    docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True
) -> DataFrame:
    """Every row with n_words, n_removed, kept_sha256 and, with_text, the kept words as kept_text."""
    space = Workspace(docs.sparkSession)
    out = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    own = [c for c in docs.columns if c not in out and c != text]
    docs, key = one_text_each(docs, key, text, space)
    spans = repeated_spans(docs, key, text, space).select("_doc", "_at", "_words").groupBy("_doc").agg(
        F.collect_list(F.struct("_at", "_words")).alias("_spans")  # one document's
    )
    plain = docs.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)],
        F.col(f"`{key}`").cast("long").alias("_k"), F.col(f"`{text}`").alias("_text"),
    )
    joined = plain.join(spans, F.col("_k").eqNullSafe(F.col("_doc")), "left").select(
        *[f"_c{i}" for i in range(len(own))], "_text",
        F.col("_spans._at").alias("_at"), F.col("_spans._words").alias("_n"),
    )
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-3])
    spec += ", n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    done = joined.mapInArrow(_cut(with_text), spec)
    return done.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], *out)
