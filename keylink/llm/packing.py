"""Shortest-pack-first packing over the length histogram.

Each text becomes token ids and an end id, cut into pieces of at most ``limit`` ids: full ones and a
rest. The histogram of piece lengths (at most ``limit`` rows, however many documents there are) goes
to the driver, which places lengths longest first: each into the pack with the most room, in whole
batches of equal packs, so that it handles packing patterns and their counts, never documents. The
patterns are joined back to the pieces by length and rank.

Defined results: a null or empty text is its end id alone; repeated rows are packed each on its own;
an empty table gives no pieces; input columns of any name stay, apart from those that a result
column of the same name replaces.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keylink.llm import textarrays as ta
from keylink.sources.workspace import Workspace

LIMIT = 4096
END_ID = 2
RANK_SALTS = 64
# Texts are cut into units and hashed so many bytes at a time.
CHUNK_BYTES = 1 << 19
# The words of one Python worker that are kept with their ids; then it starts anew.
MEMORY_UNITS = 1_000_000

_ASCII = np.zeros(256, dtype=np.uint8)
_ASCII[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = 1
_ASCII[[*range(ord("0"), ord("9") + 1)]] = 2


class WordTokenizer:
    """Ids of whole texts, each distinct word being tokenized once.

    The tokenizer splits at white space before anything else that could join two words, so the ids
    of a text are those of its words in a row. Plain ASCII words are split further between letters,
    digits and signs, where the tokenizer splits too; words with other characters or an apostrophe
    stay whole. Words are known by 64-bit hashes.
    """

    def __init__(self, path: str):
        # A task has one core; the library's threads, one a core of the machine, hold memory each.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        # Hashes in rising order with the place and number of their ids: arrays, as there are two
        # workers and more beside an executor's heap, and objects would take ten times the memory.
        self.keys = np.zeros(0, dtype=np.uint64)
        self.begin = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int32)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def _add(self, keys: np.ndarray, at: np.ndarray, words: list[bytes]) -> None:
        """Keeps the ids of words whose hashes, in rising order, go before the places ``at``."""
        encode = self.tokenizer.encode_batch_fast
        sizes = []
        first = self.used
        for lo in range(0, len(words), 10_000):
            part = [w.decode("utf-8", "replace") for w in words[lo : lo + 10_000]]
            lists = [e.ids for e in encode(part, add_special_tokens=False)]
            flat = np.array([i for x in lists for i in x], dtype=np.uint32)
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            sizes.append(np.fromiter(map(len, lists), dtype=np.int32, count=len(lists)))
        size = np.concatenate(sizes)
        self.keys = np.insert(self.keys, at, keys)
        self.begin = np.insert(self.begin, at, first + np.cumsum(size, dtype=np.int64) - size)
        self.size = np.insert(self.size, at, size)

    def encode(self, c: ta.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk in a row, and the number of each document's."""
        starts, ends, doc = _units(c)
        hashes = ta.window_hashes(ta._BYTES[ta.LOWER[c.data]], starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > MEMORY_UNITS:
            self.clear()
        place = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != distinct[inside]
        if new.any():
            at = first[new]
            text = ta.LOWER[c.data].tobytes()
            words = [text[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self._add(distinct[new], place[new], words)
            place += np.cumsum(new) - new
        size, begin = self.size[place][which], self.begin[place][which]
        unit, at = ta.spread(size)
        counts = np.bincount(doc, size, c.hi - c.lo).astype(np.int64)
        return self.ids[begin[unit] + at], counts


def _units(c: ta.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds and document of the parts of words that are tokenized one by one."""
    starts, ends = c.word_bounds
    if not len(starts):
        return starts, ends, starts
    kind = _ASCII[c.data]
    odd = (c.data >= 0x80) | (c.data == ord("'")) | (c.data == 0x00)
    counts = np.zeros(len(c.data) + 1, dtype=np.int32)
    np.cumsum(odd, out=counts[1:])
    whole = counts[ends] > counts[starts]
    # "<|" opens the strings of special tokens, whose words stay whole as well
    mark = np.zeros(len(c.data) + 1, dtype=np.int32)
    np.cumsum((c.data == ord("<")) & (np.append(c.data[1:], 0) == ord("|")), out=mark[1:])
    whole |= mark[ends] > mark[starts]
    edge = np.zeros(len(c.data) + 1, dtype=bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    keep = np.zeros(len(c.data) + 2, dtype=np.int8)
    keep[starts[whole]] += 1
    np.subtract.at(keep, ends[whole], 1)
    edge &= ~(np.cumsum(keep[: len(edge)]) > 0)
    inside = ~ta.WHITE[c.data]
    edge[:-1] &= inside
    edge[-1] = False
    edge[starts] = True
    begin = np.flatnonzero(edge)
    word = np.searchsorted(starts, begin, "right") - 1
    stop = np.minimum(np.append(begin[1:], len(c.data)), ends[word])
    return begin, stop, np.searchsorted(c.offsets, begin, "right") - 1


def _tokenize(path: str, limit: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            own = batch.num_columns - 1
            for c in ta.chunks(batch.column(own), CHUNK_BYTES):
                ids, counts = tokenizer.encode(c)
                counts = counts + 1
                docs = len(counts)
                flat = np.full(int(counts.sum()), end_id, dtype="<u4")
                last = np.zeros(len(flat), dtype=bool)
                last[np.cumsum(counts) - 1] = True
                flat[~last] = ids
                doc, at = ta.spread(-(-counts // limit))
                start = at * limit
                length = np.minimum(limit, counts[doc] - start)
                begin = (np.cumsum(counts) - counts)[doc] + start
                view = memoryview(flat.tobytes())
                crc = [
                    zlib.crc32(view[4 * b : 4 * (b + n)])
                    for b, n in zip(begin.tolist(), length.tolist(), strict=True)
                ]
                assert docs == c.hi - c.lo
                rows = pa.array(c.lo + doc)
                cols = [batch.column(i).take(rows) for i in range(own)]
                cols += [pa.array(x, pa.int64()) for x in (start, length, crc, counts[doc])]
                names = [*batch.schema.names[:own], "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(ta.lists(flat.astype(np.int32), length, pa.int32()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        # The worker stays for later stages, which need the memory of these batches.
        pa.default_memory_pool().release_unused()

    return run


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[tuple[int, list[int]]]:
    """Packing patterns as (number of packs, lengths in them), for {length: pieces}."""
    open_: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by room left
    room = 0  # no open pack has more
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while room and not open_.get(room):
                room -= 1
            if room < length:
                open_[limit - length].append((left, [length]))
                room = max(room, limit - length)
                break
            packs, lengths = open_[room].pop()
            used = min(packs, left)
            if packs > used:
                open_[room].append((packs - used, lengths))
            open_[room - length].append((used, [*lengths, length]))
            left -= used
    return [x for packs in open_.values() for x in packs]


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, packs, first sequence, offset): ranks go to the packs one by one."""
    ranks: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for packs, lengths in patterns:
        offset = 0
        for length in lengths:
            out.append((length, ranks[length], packs, sequence, offset))
            ranks[length] += packs
            offset += length
        sequence += packs
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    limit: int = LIMIT,
    end_id: int = END_ID,
    text: str = "text",
    with_ids: bool = True,
    space: Workspace | None = None,
) -> DataFrame:
    """Per piece: the input columns without the text, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, with_ids, the ids themselves. ``tokenizer`` is a file's path."""
    new = ["start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    own = [c for c in docs.columns if c not in (text, "sequence_id", "offset", *new)]
    plain = docs.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)],
        F.monotonically_increasing_id().alias("_row"),
        F.col(f"`{text}`").alias("_text"),
    )
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    spec += ", start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = (space or Workspace(docs.sparkSession)).save(
        plain.mapInArrow(_tokenize(tokenizer, limit, end_id, with_ids), spec), "pieces"
    )
    rows = pieces.groupBy("length").count().collect()  # at most `limit` rows
    placed = slots(shortest_pack_first({r["length"]: r["count"] for r in rows}, limit))
    spark = docs.sparkSession
    table = spark.createDataFrame(
        placed, "_length long, _first long, _packs long, _sequence long, _offset long"
    )
    # Ranks within a length: numbers within salted parts, after the sizes of the parts before.
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_row", "start"), F.lit(RANK_SALTS)))
    part = Window.partitionBy("length", "_salt")
    before = (
        salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"),
        )
        .select(F.col("length").alias("_l2"), F.col("_salt").alias("_s2"), "_before")
    )
    ranked = (
        salted.withColumn("_nth", F.row_number().over(part.orderBy("_row", "start")) - 1)
        .join(before, (F.col("length") == F.col("_l2")) & (F.col("_salt") == F.col("_s2")))
        .withColumn("_rank", F.col("_nth") + F.col("_before"))
    )
    # The table has as many rows as the patterns have places: bounded by the limit, not by the data.
    put = ranked.join(
        F.broadcast(table),
        (F.col("length") == F.col("_length"))
        & (F.col("_rank") >= F.col("_first"))
        & (F.col("_rank") < F.col("_first") + F.col("_packs")),
    )
    return put.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)],
        *new,
        (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"),
        F.col("_offset").alias("offset"),
    )
