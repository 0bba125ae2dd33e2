import hashlib
import random
import re

import edges
from keylink.llm.substring_dedup import drop_repeated_words
from keylink.sources.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    seen, words = {}, {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for s in range(len(words[i]) - 19):
            seen.setdefault(tuple(words[i][s : s + 20]), (i, s))
    out = {}
    for i, ws in words.items():
        gone = set()
        for s in range(len(ws) - 19):
            if seen[tuple(ws[s : s + 20])] != (i, s):
                gone |= set(range(s, s + 20))
        left = " ".join(w for n, w in enumerate(ws) if n not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


def check(frame):
    expected = brute([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()])
    got = drop_repeated_words(frame).collect()
    assert len(got) == len(expected)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == expected[r["doc_id"]], r["doc_id"]
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
    assert sum(e[1] for e in expected.values()) > 0


def test_same_as_brute_force(spark, sample):
    check(spark.read.parquet(f"{sample}/documents.parquet"))
    for seed in (1, 2):
        check(edges.frame(spark, seed=seed))


def test_rows_of_one_id_with_other_texts(spark):
    """Spans of one row are never cut out of another one that only has the same id."""
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    half = " ".join(a.split(" ")[:30]) + " " + " ".join(f"c{i}" for i in range(9))
    rows = [(i, t, None, None, 1, *edges.CLASH) for i, t in ((1, a), (5, a), (5, b), (5, b), (6, half), (None, None), (None, b))]
    got = drop_repeated_words(edges.frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got) == [
        (0, 0, 0), (0, 60, 0), (1, 60, 0), (5, 60, 60), (5, 60, 60), (5, 60, 60), (6, 39, 30),
    ]
    apart = [(i, t, None, None, 1, *edges.CLASH) for i, t in ((1, a), (5, a), (5, b))]
    got = drop_repeated_words(edges.frame(spark, apart)).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in got) == [(1, 0, a), (5, 0, b), (5, 60, "")]
    assert {(r["_row"], r["a.b"]) for r in got} == {edges.CLASH}


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, None, None, 1, *edges.CLASH), (3, text, None, None, 1, *edges.CLASH)] * 2
    got = drop_repeated_words(edges.frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (0, 0), (3, 30), (3, 30)]
    assert drop_repeated_words(edges.empty(spark)).collect() == []


def test_runs_that_overlap_in_part(spark):
    """Passages are cut and joined anywhere, so that runs share some of their windows."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)] + ["x"] * 40 + [f"b{i}" for i in range(60, 120)]
    rows = []
    for i in range(40):
        words = []
        for _ in range(rng.randrange(1, 5)):
            lo = rng.randrange(len(base) - 15)
            words += base[lo : lo + rng.randrange(15, 70)] + [f"o{i}"] * rng.randrange(2)
        rows.append((i, " ".join(words), None, None, 1, *edges.CLASH))
    check(edges.frame(spark, rows))


def test_copies_make_no_row_per_window(spark, monkeypatch):
    made, save = {}, Workspace.save
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(i, text, None, None, 1, *edges.CLASH) for i in range(10)]

    def counting(self, frame, name):
        saved = save(self, frame, name)
        made[name] = saved.count()
        return saved

    monkeypatch.setattr(Workspace, "save", counting)
    got = drop_repeated_words(edges.frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(i, 400 * (i > 0)) for i in range(10)]
    assert sum(made.values()) < 10 * 381  # windows of all documents
