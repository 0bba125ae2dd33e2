import math
import random
import re

import edges
import numpy as np
import pytest
from checks.compare import compare, database
from keylink.llm import lexical
from keylink.llm.lexical import search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, rank int, `a.b` string"


def terms(text):
    return TERMS.findall((text or "").translate(UPPER))


def brute(docs, items, top=10):
    listed = [(d, terms(t)) for d, t in docs]
    listed = [(d, t) for d, t in listed if t]
    n_docs, total = len(listed), sum(len(t) for _, t in listed)
    df = {}
    for _, t in listed:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        asked = terms(text)
        scores = []
        for d, t in listed:
            m = 100 - 75 + (75 * len(t) * n_docs) // total
            s = 0
            for x in asked:
                tf = t.count(x)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    s += w * ((10**9 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        for rank, e in enumerate(sorted(scores, key=lambda e: e[:3])[:top], 1):
            out.append((item, rank, e[3], -e[0]))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=str)


def awkward():
    rng = random.Random(8)
    docs = edges.documents(n=120) + [
        (None, "w1x w2x rare", None, None, 1, *edges.CLASH),
        (3, "twin w1x", None, None, 1, *edges.CLASH),
        (700, "w5x " * 30_000 + "needle", None, None, 1, *edges.CLASH),
    ]
    docs += [(800 + i, "tie tie breaker", None, None, 1, *edges.CLASH) for i in range(30)]
    texts = [None, "", "?? !", "tie", "TIE breaker tie", "needle", "nowhere-to-be-found", "漢字かな交じり文 ünïcödé Ünïcödé", "rare w1x"]
    texts += [" ".join(f"w{rng.randrange(400)}x" for _ in range(rng.randrange(1, 40))) for _ in range(25)]
    texts += [texts[-1], docs[5][1], "w1x " * 5000]
    return docs, [(i % 30, t, 1, "x") for i, t in enumerate(texts)]


@pytest.mark.parametrize("rows", (1, 512))
def test_equals_scoring_everything(spark, rows, monkeypatch):
    monkeypatch.setattr(lexical, "BUCKET_ROWS", rows)
    docs, items = awkward()
    expected = brute([(d[0], d[1]) for d in docs], [(i[0], i[1]) for i in items])
    for parts in (1, 6):
        frame = edges.frame(spark, docs).repartition(parts)
        assert rows_of(search(frame, spark.createDataFrame(items, ITEMS))) == expected


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 60)
    docs, items = awkward()
    expected = brute([(d[0], d[1]) for d in docs], [(i[0], i[1]) for i in items])
    assert rows_of(search(edges.frame(spark, docs), spark.createDataFrame(items, ITEMS))) == expected


def test_empty_sides(spark):
    docs, items = awkward()
    frame, asked = edges.frame(spark, docs), spark.createDataFrame(items, ITEMS)
    assert search(edges.empty(spark), asked).collect() == []
    none = search(frame, asked.filter("false"))
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]
    blank = [(1, t, None, None, None, *edges.CLASH) for t in (None, "", " ?")]
    assert search(edges.frame(spark, blank), asked).collect() == []


def test_bounds_prune_and_lose_nothing():
    """One bucket against scoring all its vectors; the bounds leave many of them out."""
    rng = np.random.default_rng(3)
    weights = rng.integers(10, 9000, 200)
    roots = np.sqrt(weights.astype(float))
    count = rng.integers(3, 30, 4000)
    term = np.concatenate([rng.choice(200, n, replace=False) for n in count])
    value = rng.integers(1000, 900_000, len(term))
    owner = np.repeat(np.arange(4000), count)
    length = np.sqrt(np.bincount(owner, (roots[term] * value) ** 2))
    bucket = lexical.Bucket(list(range(4000)), length, count, term, value, roots)
    numbers = np.array([3, 7, 7, 40, 41, 90, 150])
    q = lexical.make_query(numbers, weights, roots)
    full = np.zeros(4000, dtype=np.int64)
    for x in numbers:
        full[owner[term == x]] += weights[x] * value[term == x]
    order = sorted(range(4000), key=lambda i: (-full[i], i))[:10]
    seen = np.zeros(2, dtype=np.int64)
    best = lexical._Best(10, int(full[order[9]]))
    bucket.search(q, best, seen)
    assert sorted((-e[0], e[3]) for e in best.heap) == [(-full[i], i) for i in order]
    assert seen[1] < 0.6 * 4000
    none = lexical._Best(10, int(q.length * length.max() * 1.01))
    bucket.search(q, none, seen)
    assert none.heap == []


def test_query_equals_sql(spark, sample):
    same, count, note = compare(spark, database(sample), sample, "op13_norm_buckets")
    assert same and count > 0, note
