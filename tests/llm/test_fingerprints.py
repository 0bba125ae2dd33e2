import hashlib
import random

import edges
from keylink.llm.fingerprints import compare_with_edits, within_radius
from pyspark.sql import functions as F


def ham(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def check(frame):
    rows = [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    got = compare_with_edits(frame).collect()
    assert len(got) == len(rows)
    by_text = {}
    expected = {}
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        m = len(text) // 4
        new = text[: len(text) - m] + following[:m]
        expected.setdefault(i, []).append((len(text), hashlib.sha256(new.encode()).hexdigest(), text, following, new))
    prints = {}
    for r in got:
        options = [e for e in expected[r["doc_id"]] if e[:2] == (r["n_chars"], r["edited_sha256"])]
        assert options
        assert prints.setdefault(options[0][2], r["fingerprint"]) == r["fingerprint"]
    for r in got:
        _, _, _, following, new = next(
            e for e in expected[r["doc_id"]] if e[:2] == (r["n_chars"], r["edited_sha256"])
        )
        assert r["near_edited"] == 1 - ham(r["fingerprint"], r["edited_fingerprint"]) / 128
        assert r["near_next"] == 1 - ham(r["fingerprint"], prints[following]) / 128
        if new in prints:
            assert r["edited_fingerprint"] == prints[new]
        if r["doc_id"] is not None and r["doc_id"] % 100 == 0:
            assert r["n_near"] == sum(ham(r["fingerprint"], o["fingerprint"]) <= 3 for o in got)
        else:
            assert r["n_near"] is None
    return got


def test_edits_neighbours_and_search(spark, sample):
    got = check(spark.read.parquet(f"{sample}/documents.parquet"))
    long = [r for r in got if r["n_chars"] > 500]
    assert sum(r["near_edited"] > 0.65 for r in long) > 0.97 * len(long)
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.97 * len(long)


def test_awkward_rows(spark):
    rows = edges.documents() + [(None, "a b", None, None, 1, *edges.CLASH), (3, "twin", None, None, 1, *edges.CLASH)]
    check(edges.frame(spark, rows))
    check(edges.frame(spark, [(5, "only one", "en", "s", 1, *edges.CLASH)]))
    assert compare_with_edits(edges.empty(spark)).collect() == []


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(128) for _ in range(5)]
    prints = set()
    for c in centres:
        for _ in range(60):
            x = c
            for _ in range(rng.randrange(0, 8)):
                x ^= 1 << rng.randrange(128)
            prints.add(x)
    split = lambda x: tuple(v - (1 << 64) if v >> 63 else v for v in (x >> 64, x & (2**64 - 1)))
    frame = spark.createDataFrame([split(x) for x in prints], "f0 long, f1 long")
    for radius, blocks in ((3, 4), (6, 8)):
        got = {tuple(r) for r in within_radius(frame, frame, radius, blocks).collect()}
        assert got == {
            (*split(a), *split(b)) for a in prints for b in prints if bin(a ^ b).count("1") <= radius
        }
    assert within_radius(frame, frame.filter(F.lit(False))).count() == 0


def test_near_copies_are_found_with_their_ids(spark):
    """Copies of a document of 300 words with one to three words changed, and an exact copy."""
    rng = random.Random(4)
    base = edges.words(rng, 300, 10**6).split(" ")
    rows = [(100, " ".join(base)), (101, " ".join(base))]
    for i in range(1, 31):
        own = list(base)
        for k in range(1 + i % 3):
            own[rng.randrange(300)] = f"edit{i}x{k}"
        rows.append((200 + i, " ".join(own)))
    rows += [(400 + i, edges.words(rng, 300, 10**6)) for i in range(30)]
    frame = edges.frame(spark, [(i, t, "en", "s", len(t), *edges.CLASH) for i, t in rows])
    got = {r["doc_id"]: r for r in compare_with_edits(frame).collect()}
    assert got[100]["class_id"] == got[101]["class_id"] == 100
    near = {i for i, r in got.items() if ham(r["fingerprint"], got[100]["fingerprint"]) <= 15}
    assert set(got[100]["near_classes"]) == {got[i]["class_id"] for i in near}
    assert len([i for i in near if 200 < i < 300]) >= 27 and not any(i >= 400 for i in near)
    assert got[100]["n_near"] < len(near) and got[101]["near_classes"] is None
    split = [(int(r["fingerprint"][:16], 16), int(r["fingerprint"][16:], 16)) for r in got.values()]
    signed = [tuple(v - (1 << 64) if v >> 63 else v for v in x) for x in split]
    prints = spark.createDataFrame(signed, "f0 long, f1 long")
    assert {tuple(r) for r in within_radius(prints, prints, 15, 8).collect()} == {
        (*a, *b) for a, x in zip(signed, split) for b, y in zip(signed, split)
        if sum((u ^ v).bit_count() for u, v in zip(x, y)) <= 15
    }
