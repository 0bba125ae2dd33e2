import gc
import os
import random
import struct
import subprocess
import sys
import tracemalloc
import zlib

import edges
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from keylink.llm import packing
from keylink.llm import textarrays as ta
from keylink.llm.packing import pack, shortest_pack_first, slots
from keylink.llm.queries import tokenizer_path


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("limit", [4096, 64])
def test_pieces_are_the_tokens_and_fill_sequences(spark, sample, limit):
    docs = spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text")
    for frame in (docs, edges.frame(spark).select("doc_id", "text")):
        rows = frame.collect()
        ids = dict(zip([r["doc_id"] for r in rows], reference_ids([r["text"] for r in rows]), strict=True))
        got = pack(frame, tokenizer_path(), limit=limit).collect()
        again, room = {}, {}
        for r in got:
            own = ids[r["doc_id"]]
            piece = own[r["start"] : r["start"] + r["length"]]
            assert r["ids"] == piece and r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
            again.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
            room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for i, own in ids.items():
            at = 0
            for start, length in sorted(again[i]):
                assert start == at
                at += length
            assert at == len(own)
        for parts in room.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= limit
        assert sorted(room) == list(range(len(room)))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=20))
def test_patterns_hold_every_piece_once(histogram):
    patterns = shortest_pack_first(histogram, 40)
    assert all(sum(lengths) <= 40 and n > 0 for n, lengths in patterns)
    found = {}
    for length, first, packs, _, _ in slots(patterns):
        assert found.get(length, 0) == first
        found[length] = first + packs
    assert found == histogram


def test_empty_table(spark):
    assert pack(edges.empty(spark), tokenizer_path()).collect() == []


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "some words", "en", "s", 0, *edges.CLASH)] * 5 + [(None, None, None, None, None, None, None)]
    got = pack(edges.frame(spark, rows), tokenizer_path(), limit=8).collect()
    assert sum(r["doc_id"] == 1 for r in got) == 5 and len(got) == 6
    assert [r["length"] for r in got if r["doc_id"] is None] == [1]


@pytest.mark.parametrize("kept", [40, packing.MEMORY_UNITS])
def test_words_are_found_again_whatever_came_before(monkeypatch, kept):
    monkeypatch.setattr(packing, "MEMORY_UNITS", kept)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh\u00e9", k=rng.randint(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 20))) for _ in range(80)]
    tokenizer = packing.WordTokenizer(tokenizer_path())
    got = []
    for c in ta.chunks(pa.array(texts), 200):
        ids, counts = tokenizer.encode(c)
        got += [[*x.tolist(), 2] for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == reference_ids(texts)


def test_kept_words_take_little_memory():
    first, tokenizer = (packing.WordTokenizer(tokenizer_path()) for _ in range(2))
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [" ".join(str(1000 * i + j).translate(letters) for j in range(1000)) for i in range(100, 300)]
    for one in (first, tokenizer):  # the first fills the caches of the module
        if one is tokenizer:
            tracemalloc.start()
        for c in ta.chunks(pa.array(texts), 1 << 18):
            one.encode(c)
        del c
    gc.collect()
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    held -= tokenizer.ids.nbytes
    assert held < 40 * 200_000


def test_a_worker_tokenizes_in_one_thread():
    lines = [
        "import os, pyarrow as pa",
        "from keylink.llm import packing, textarrays as ta",
        "from keylink.llm.queries import tokenizer_path",
        "tokenizer = packing.WordTokenizer(tokenizer_path())",
        "before = len(os.listdir('/proc/self/task'))",
        "texts = pa.array([' '.join(f'w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x' * (i % 9) for i in range(5000))])",
        "[tokenizer.encode(c) for c in ta.chunks(texts)]",
        "assert len(os.listdir('/proc/self/task')) == before",
    ]
    plain = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    env = {**plain, "PYTHONPATH": os.pathsep.join(sys.path)}
    subprocess.run([sys.executable, "-c", "\n".join(lines)], check=True, env=env)
