import hashlib
import math

import edges
from keylink.llm import mixing
from keylink.llm.mixing import mix


def number(digits, *parts):
    text = "|".join("null" if p is None else str(p) for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def poisson(rate, u):
    k, term = 0, math.exp(-rate)
    total = term
    while total <= u:
        k += 1
        term *= rate / k
        total += term
    return k


def brute(rows, weights=None, total=None, seed=0):
    n = {}
    for r in rows:
        n[r[3]] = n.get(r[3], 0) + 1
    w = {s: c**0.5 if weights is None else weights.get(s, 0) for s, c in n.items()}
    n = {s: c for s, c in n.items() if w[s] > 0}
    all_w, total = sum(w[s] for s in n), total or sum(n.values())
    out = []
    for r in rows:
        if r[3] in n:
            rate = w[r[3]] / all_w * total / n[r[3]]
            u = (number(13, seed, r[0]) + 0.5) / 2**52
            out += [(r[0], k, number(15, seed, "order", r[0], k)) for k in range(poisson(rate, u))]
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(((r["doc_id"], r["copy"], r["shuffle_key"]) for r in frame.collect()), key=str)


def test_counts_follow_the_poisson_inverse(spark):
    rows = [*edges.documents(n=300), (None, None, None, "src1", None, None, None)]
    frame = edges.frame(spark, rows)
    assert rows_of(mix(frame)) == brute(rows)
    weights = {"src0": 3.0, "src1": 1.0, None: 2.0}
    got = mix(frame, weights, total=5000, seed=9)
    assert rows_of(got) == brute(rows, weights, 5000, 9)
    assert got.columns == [*frame.columns, "copy", "shuffle_key"]


def test_salted_join_gives_the_same(spark, monkeypatch):
    frame = edges.frame(spark, n=200)
    plain = rows_of(mix(frame, total=900))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows_of(mix(frame, total=900)) == plain


def test_sources_reach_their_weights(spark):
    rows = [(i, "t", "en", "big" if i % 10 else "small", 1, *edges.CLASH) for i in range(20000)]
    got = mix(edges.frame(spark, rows), {"big": 1, "small": 1}).groupBy("source").count().collect()
    got = {r["source"]: r["count"] for r in got}
    assert all(abs(v - 10000) < 500 for v in got.values())


def test_large_rates_and_empty_tables(spark):
    rows = [(i, "t", "en", "s", 1, *edges.CLASH) for i in range(5)]
    assert abs(mix(edges.frame(spark, rows), total=6000).count() - 6000) < 400
    assert mix(edges.empty(spark)).collect() == []
