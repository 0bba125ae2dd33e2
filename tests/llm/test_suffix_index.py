import hashlib

import edges
import pytest
from keylink.llm import suffix_index
from keylink.llm.suffix_index import drop_repeated_bytes


def brute(rows):
    seen, raw = {}, {i: (t or "").encode() for i, t in rows}
    for i in sorted(raw):
        for s in range(len(raw[i]) - 99):
            seen.setdefault(raw[i][s : s + 100], (i, s))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if seen[b[s : s + 100]] != (i, s):
                gone[s : s + 100] = b"\x01" * 100
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def check(frame):
    expected = brute([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()])
    got = drop_repeated_bytes(frame).collect()
    assert len(got) == len(expected)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"]], r["doc_id"]
    assert sum(e[1] for e in expected.values()) > 0


def test_same_as_brute_force(spark, sample):
    check(spark.read.parquet(f"{sample}/documents.parquet"))


@pytest.mark.parametrize("hot", [1, 50_000])
def test_awkward_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_index, "HOT", hot)
    check(edges.frame(spark, seed=4))


def test_rows_of_one_id_with_other_texts(spark):
    """Spans of one row are never cut out of another one that only has the same id."""
    a = " ".join(f"first{i}" for i in range(40))
    b = " ".join(f"other{i}" for i in range(40))
    rows = [(i, t, None, None, 1, *edges.CLASH) for i, t in ((1, a), (5, a), (5, b))]
    got = drop_repeated_bytes(edges.frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept_bytes"]) for r in got) == [
        (1, 0, a.encode()), (5, 0, b.encode()), (5, len(a), b""),
    ]
    assert {(r["_row"], r["a.b"]) for r in got} == {edges.CLASH}


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text, None, None, 1, *edges.CLASH), (3, text, None, None, 1, *edges.CLASH)] * 2
    got = drop_repeated_bytes(edges.frame(spark, rows)).collect()
    n = len(text)
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (0, 0), (3, n), (3, n)]
    assert drop_repeated_bytes(edges.empty(spark)).collect() == []
