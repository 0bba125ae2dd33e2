"""Quality rules: lines that too many documents of a host share go, and depleted documents with them.

Lines are normalised (ASCII lower case, one space between words, digits as 0) and hashed. For each
host and line, *distinct* documents are counted, known by a 128-bit hash of their whole text. Near
copies count once as well: texts of a host that agree in a band of ``BAND`` minwise tokens of their
five-word shingles are compared with the least text of that band, and linked if ``ALIKE`` of all 64
tokens agree; components of links count as one document. Copies that share 95 % of their shingles
agree in a band with 0.66, documents of which 90 % is a shared text (82 % of their shingles) pass
the comparison with 1 %, so these count apart. A line is above the limit if it is in at least
``min_docs`` documents and in at least ``max_share`` of those of its host.

Defined results: a null or empty text has no lines and fails the base rules; a null host is a host;
repeated rows are judged each on its own; an empty table gives an empty table; all input columns of
any name stay, apart from those that a result column of the same name replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keylink.llm import textarrays as ta
from keylink.llm.components import components
from keylink.llm.near_dedup import POSITIONS, _minwise, _sets
from keylink.sources.workspace import Workspace

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
# Minwise tokens in a band, and how many of all POSITIONS near copies have in common at least.
BAND = 8
ALIKE = 60
_DIGITS = ta.LOWER.copy()
_DIGITS[ord("0") : ord("9") + 1] = ord("0")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_share: float = 0.5
    min_docs: int = 20
    max_share: float = 0.01
    min_left_share: float = 0.5


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = ", ".join(f"{c} long" for c in _COUNTS) + (
    ", _same binary, _tokens array<int>, _lines array<long>, _line_words array<int>"
)


def _line_tables(c: ta.Chunk):
    """Lines with a word: document, normalised hash, raw hash, first word, number of words."""
    n = len(c.data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[c.offsets] = True
    cut[1:] |= np.append(c.data, 0)[:n] == 0x0A
    line_at = np.flatnonzero(cut[:n])
    starts, ends = c.word_bounds
    first = np.searchsorted(starts, line_at)
    count = np.diff(np.append(first, len(starts)))
    has = count > 0
    line_at, first, count = line_at[has], first[has], count[has]
    doc = np.searchsorted(c.offsets, line_at, "right") - 1
    shown = ta.window_hashes(ta._BYTES[_DIGITS[c.data]], starts, ends)
    normal = ta.window_hashes(shown, first, first + count)
    # a line without its line break, from its first to its last byte
    end = np.append(np.flatnonzero(cut)[1:], n)[: len(has)][has]
    end = end - (c.data[end - 1] == 0x0A)
    raw = ta.window_hashes(ta._BYTES[c.data], line_at, end)
    return doc, normal, raw, count


def _sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n).astype(np.int64)


def _measure(c: ta.Chunk) -> dict[str, np.ndarray]:
    docs = c.hi - c.lo
    byte_doc = np.repeat(np.arange(docs), np.diff(c.offsets))
    solid = ~ta.WHITE[c.data] & ((c.data & 0xC0) != 0x80)
    words = np.diff(c.first_word)
    hashes = c.word_hashes()
    three, doc, at = c.shingles(3, hashes, whole=False)
    order = np.lexsort((three, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (three[order][1:] == three[order][:-1])
    again = np.zeros(len(three), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(hashes), dtype=bool)
    begin = c.first_word[doc[again]] + at[again]
    for k in range(3):
        covered[begin + k] = True
    word_doc = np.repeat(np.arange(docs), words)
    line_doc, normal, raw, count = _line_tables(c)
    order = np.lexsort((raw, line_doc))
    repeats = (line_doc[order][1:] == line_doc[order][:-1]) & (raw[order][1:] == raw[order][:-1])
    dup = np.bincount(line_doc[order][1:][repeats], minlength=docs)
    same = np.zeros((docs, 2), dtype=np.uint64)
    for which in range(2):
        same[:, which] = ta.window_hashes(ta._BYTES[c.data], c.offsets[:-1], c.offsets[1:], which)
    flat = same.tobytes()
    # each normalised line once per document, with the words of all its occurrences
    order = np.lexsort((normal, line_doc))
    d, h, w = line_doc[order], normal[order], count[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at_new = np.flatnonzero(new)
    return {
        "n_words": words,
        "word_chars": _sums(solid, byte_doc, docs),
        "n_symbols": _sums(SYMBOLS[c.data], byte_doc, docs),
        "n_dup_lines": dup,
        "n_repeat_words": _sums(covered, word_doc, docs),
        "_same": [flat[16 * i : 16 * i + 16] for i in range(docs)],
        "_tokens": _minwise(*_sets(c))[0].ravel().view(np.int32),
        "lines": h[at_new].view(np.int64),
        "line_words": np.add.reduceat(w, at_new) if len(at_new) else w[:0],
        "line_count": np.bincount(d[at_new], minlength=docs),
    }


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in ta.chunks(batch.column(batch.num_columns - 1)):
            m = _measure(c)
            own = [batch.column(i)[c.lo : c.hi] for i in range(batch.num_columns - 1)]
            cols = [pa.array(m[k], pa.int64()) for k in _COUNTS]
            cols += [
                pa.array(m["_same"], pa.binary()),
                ta.lists(m["_tokens"], np.full(c.hi - c.lo, POSITIONS), pa.int32()),
                ta.lists(m["lines"], m["line_count"], pa.int64()),
                ta.lists(m["line_words"].astype(np.int32), m["line_count"], pa.int32()),
            ]
            names = [*batch.schema.names[:-1], *_COUNTS, "_same", "_tokens", "_lines", "_line_words"]
            yield pa.RecordBatch.from_arrays([*own, *cols], names)


def _distinct(measured: DataFrame, space: Workspace) -> DataFrame:
    """(_host, _same, _doc): the distinct texts of each host, near copies under one _doc."""
    own = F.concat(F.coalesce(F.concat(F.lit("h"), F.col("_host")), F.lit("n")), F.lit("|"), F.hex("_same"))
    texts = space.save(
        measured.groupBy("_host", "_same")
        .agg(F.first("_tokens").alias("_tokens"), F.max("n_words").alias("n_words"))
        .withColumn("_own", F.unhex(F.md5(own))),
        "texts",
    )
    bands = [
        F.xxhash64(F.coalesce(F.concat(F.lit("h"), F.col("_host")), F.lit("n")), F.lit(i), F.slice("_tokens", i + 1, BAND))
        for i in range(0, POSITIONS, BAND)
    ]
    member = texts.filter("n_words > 0").select("_own", F.explode(F.array(*bands)).alias("_node"))
    pivots = (
        member.groupBy("_node").agg(F.min("_own").alias("_pivot"), F.count("*").alias("_k"))
        .filter("_k > 1").select(F.col("_node").alias("_node2"), "_pivot")
    )
    pairs = (
        member.join(pivots, F.col("_node") == F.col("_node2")).filter("_own <> _pivot")
        .select("_own", "_pivot").distinct()
    )
    tokens = texts.select(F.col("_own").alias("_o2"), F.col("_tokens").alias("_y"))
    agree = F.size(F.filter(F.zip_with("_x", "_y", lambda x, y: x == y), lambda same: same))
    links = (
        pairs.join(tokens.withColumnsRenamed({"_o2": "_o1", "_y": "_x"}), F.col("_own") == F.col("_o1"))
        .join(tokens, F.col("_pivot") == F.col("_o2"))
        .filter(agree >= ALIKE)
        .select(F.col("_own").alias("u"), F.col("_pivot").alias("v"))
    )
    joined = components(space.save(links, "links"), space)
    return texts.join(joined, F.col("_own") == F.col("u"), "left").select(
        "_host", "_same", F.coalesce("v", "_own").alias("_doc")
    )


def _frequent(measured: DataFrame, rules: QualityRules, space: Workspace) -> DataFrame:
    """(host, line) above the limits. Copies are merged before any shuffle by line."""
    known = space.save(_distinct(measured, space), "known")
    lines = measured.select("_host", "_same", F.explode("_lines").alias("_line")).distinct()
    # merging near copies only lowers a count
    maybe = (
        lines.groupBy("_host", "_line").agg(F.count("*").alias("_n"))
        .filter(F.col("_n") >= rules.min_docs).select(F.col("_host").alias("_h2"), F.col("_line").alias("_l2"))
    )
    lines = lines.join(
        maybe, (F.col("_line") == F.col("_l2")) & F.col("_host").eqNullSafe(F.col("_h2")), "left_semi"
    )
    docs = known.select(F.col("_host").alias("_h3"), F.col("_same").alias("_s3"), "_doc")
    seen = (
        lines.join(docs, (F.col("_same") == F.col("_s3")) & F.col("_host").eqNullSafe(F.col("_h3")))
        .select("_host", "_doc", "_line").distinct()
    )
    hosts = known.select("_host", "_doc").distinct().groupBy("_host").agg(F.count("*").alias("_docs"))
    counts = seen.groupBy("_host", "_line").agg(F.count("*").alias("_n"))
    often = counts.filter(F.col("_n") >= rules.min_docs)
    return (
        often.join(hosts, often["_host"].eqNullSafe(hosts["_host"]))
        .filter(F.col("_n") >= F.col("_docs") * rules.max_share)
        .select(often["_host"], "_line")
    )


def quality(
    docs: DataFrame,
    rules: QualityRules = QualityRules(),
    text: str = "text",
    host: str = "source",
    with_text: bool = True,
    space: Workspace | None = None,
) -> DataFrame:
    """Every row with its counts, ``base_failed``, ``kept`` and, with_text, ``clean_text``.

    clean_text is the text without the lines above the limits. Without with_text the text is
    measured in one pass and never shuffled; with it, it is shuffled once, as the result is read.
    """
    out = (*_COUNTS, "n_left", "base_failed", "kept", "clean_text")
    own = [c for c in docs.columns if c != text and c not in out]
    if with_text:
        own.append(text)
    space = space or Workspace(docs.sparkSession)
    # the columns travel under numbers, so that no name of theirs can clash with a name used here
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)],
        F.col(f"`{host}`").cast("string").alias("_host"),
        F.monotonically_increasing_id().alias("_row"),
        F.col(f"`{text}`").alias("_text"),
    )
    columns = [f"_c{i}" for i in range(len(own))]
    # texts stay where they are: what is found of a row is a matter of its host and text
    plain = rows.select("_host", "_row", _name().alias("_name"), "_text") if with_text else rows
    scratch = Workspace(docs.sparkSession, space.root) if with_text else space
    ahead = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    measured = scratch.save(plain.mapInArrow(_measure_batches, f"{ahead}, {_SCHEMA}"), "measured")
    often = _frequent(measured, rules, scratch)
    pairs = measured.select(
        "_row", "_host", F.explode(F.arrays_zip("_lines", "_line_words")).alias("_l")
    ).select("_row", "_host", F.col("_l._lines").alias("_line"), F.col("_l._line_words").alias("_w"))
    lost = (
        pairs.join(
            often.withColumnsRenamed({"_host": "_h2", "_line": "_l2"}),
            (F.col("_line") == F.col("_l2")) & F.col("_host").eqNullSafe(F.col("_h2")),
        )
        .groupBy("_row")
        .agg(F.sum("_w").alias("_lost"), F.collect_list("_line").alias("_bad"))
    )
    n_left = F.col("n_words") - F.coalesce("_lost", F.lit(0))
    failed = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") > F.col("n_words") * rules.max_repeat_share
    )
    judged = (
        measured.join(lost, "_row", "left")
        .withColumn("n_left", n_left)
        .withColumn("base_failed", failed)
        .withColumn(
            "kept", ~failed & (F.col("n_left") >= F.col("n_words") * rules.min_left_share)
        )
    )
    shown = [*_COUNTS, "n_left", "base_failed", "kept"]
    if with_text:
        found = judged.select(F.col("_name").alias("_found"), *shown, "_bad").dropDuplicates(["_found"])
        found = space.save(found, "found")
        scratch.clear()
        judged = rows.select(*columns, _name().alias("_name"), "_text").join(
            found, F.col("_name") == F.col("_found"), "left"
        )
        fields = judged.select(*columns, *shown).schema
        spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        judged = judged.select(*columns, *shown, "_bad", "_text").mapInArrow(_drop_lines, f"{spec}, clean_text string")
        shown.append("clean_text")
    return judged.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], *shown)


def _name() -> Column:
    """A row's host and the SHA-256 of its text; nulls are equal in it."""
    return F.struct("_host", F.unhex(F.sha2("_text", 256)).alias("hash"))


def _drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bad, texts = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        clean = []
        for gone, text in zip(bad.to_pylist(), texts.to_pylist(), strict=True):
            if gone:
                lines = text.split("\n")
                hashes = _line_hashes(lines)
                gone = set(gone)
                text = "\n".join(
                    x for x, h in zip(lines, hashes, strict=True) if h not in gone
                )
            clean.append(text)
        cols = [batch.column(i) for i in range(batch.num_columns - 2)]
        names = [*batch.schema.names[:-2], "clean_text"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(clean, pa.string())], names)


def _line_hashes(lines: list[str]) -> list[int | None]:
    """The normalised hash of each line, None for one without words."""
    out: list[int | None] = []
    for c in ta.chunks(pa.array(lines, pa.string())):
        doc, normal, _, _ = _line_tables(c)
        part: list[int | None] = [None] * (c.hi - c.lo)
        for d, h in zip(doc.tolist(), normal.view(np.int64).tolist(), strict=True):
            part[d] = h
        out += part
    return out
