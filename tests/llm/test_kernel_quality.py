import math
import random
import re
import zlib

import edges
import numpy as np
import pytest
from keylink.llm import kernel_quality as kq
from keylink.llm import textarrays as ta
from keylink.llm.kernel_quality import FEATURES, UNIT, features_of, isotonic, score_quality
import pyarrow as pa

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def plain_features(text):
    text = text or ""
    words = WORD.findall(text)
    n = max(len(words), 1)
    solid = [ch for ch in text if not re.match(r"[\x20\x09-\x0D]", ch)]
    s = max(len(solid), 1)
    lines = [WORD.findall(x) for x in text.split("\n")]
    lines = [tuple(x) for x in lines if x]
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    later, seen = set(), set()
    for i, t in enumerate(threes):
        if t in seen:
            later |= {i, i + 1, i + 2}
        seen.add(t)
    alnum = lambda ch: ch.isascii() and ch.isalnum() or not ch.isascii()
    upper = lambda w: sum("A" <= ch <= "Z" for ch in w)
    kinds = {
        "symbols": "#*$%&|<>", "marks": "!?", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "digits": "0123456789", "points": ".,;:",
    }
    out = {k: sum(ch in v for ch in solid) / s for k, v in kinds.items()}
    known = set("".join(kinds.values()))
    out["other_punctuation"] = sum(not alnum(ch) and ch not in known for ch in solid) / s
    out["non_ascii"] = sum(not ch.isascii() for ch in solid) / s
    out["log_chars"], out["log_words"] = math.log1p(len(text)) / 4, math.log1p(len(words)) / 4
    out["word_chars"] = sum(map(len, words)) / n / 8
    out["bare_words"] = sum(not any(map(alnum, w)) for w in words) / n
    out["symbol_ends"] = sum(w[-1] in kinds["symbols"] for w in words) / n
    out["mark_ends"] = sum(w[-1] in "!?" for w in words) / n
    out["upper_words"] = sum(upper(w) > 1 and 2 * upper(w) > len(w) for w in words) / n
    out["distinct_words"] = len(set(words)) / n
    out["same_as_before"] = sum(a == b for a, b in zip(words, words[1:])) / n
    out["repeat_words"] = len(later) / n
    out["dup_lines"] = (len(lines) - len(set(lines))) / max(len(lines), 1)
    out["line_words"] = math.log1p(len(words) / max(len(lines), 1)) / 4
    out["long_words"] = sum(len(w) > 20 for w in words) / n
    return [min(round(out[name] * UNIT), kq.CEILING) for name in FEATURES]


def auc(scores, labels):
    ones = np.sort([s for s, y in zip(scores, labels) if y])
    zeros = np.array([s for s, y in zip(scores, labels) if not y])
    above = len(ones) - np.searchsorted(ones, zeros, "right")
    ties = np.searchsorted(ones, zeros, "right") - np.searchsorted(ones, zeros, "left")
    return (above + 0.5 * ties).mean() / len(ones)


def test_features_equal_a_plain_count(spark, sample):
    texts = [r[1] for r in edges.documents()] + ["very " * 30_000, "Ä!" * 50_000]
    texts += [r["text"] for r in spark.read.parquet(f"{sample}/documents.parquet").select("text").collect()]
    got = np.concatenate([features_of(c) for c in ta.chunks(pa.array(texts, pa.string()))])
    expected = np.array([plain_features(t) for t in texts])
    assert np.abs(got - expected).max() <= 1  # rounding of a half


def test_pools_rise_and_keep_the_mean():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 9, 300)
    ones = rng.binomial(counts, np.linspace(0.1, 0.9, 300))
    at, share = isotonic(np.arange(300.0), ones.astype(float), counts.astype(float))
    assert (np.diff(share) > 0).all() and (np.diff(at) > 0).all()
    # the least-squares rising fit by its min-max formula
    cum_y, cum_n = np.append(0, ones.cumsum()), np.append(0, counts.cumsum())
    for i in range(0, 300, 23):
        low = max(min((cum_y[j + 1] - cum_y[k]) / (cum_n[j + 1] - cum_n[k]) for j in range(i, 300)) for k in range(i + 1))
        assert np.isclose(share, low).any()


@pytest.fixture(scope="module")
def scored(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_quality(docs, labels, with_text=False).collect()
    return rows, {r["doc_id"]: r["quality"] for r in labels.collect()}


def test_held_out_rows_are_told_apart(scored):
    rows, labels = scored
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    truth = [labels[r["doc_id"]] for r in held]
    assert len(held) > 50 and auc([r["score"] for r in held], truth) > 0.98
    assert np.mean([r["predicted"] == y for r, y in zip(held, truth)]) > 0.96


def test_held_out_labels_change_nothing(spark, scored):
    """Labels of held-out rows, whatever they say, leave every score as it is."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr(
        "doc_id",
        "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality",
    )
    again = score_quality(docs.repartition(5), flipped, with_text=False).collect()
    assert {(r["doc_id"], r["score"]) for r in again} == {(r["doc_id"], r["score"]) for r in scored[0]}


def test_awkward_rows(spark):
    rows = edges.documents() + [(None, "a b", None, None, 1, *edges.CLASH), (3, "twin", None, None, 1, *edges.CLASH)]
    frame = edges.frame(spark, rows).withColumnRenamed("n_chars", "score")
    rng = random.Random(2)
    labels = [(r[0], rng.randrange(2), 0) for r in rows] + [(5, 1, 0), (5, 1, 0), (6, None, 1), (10**9, 1, 1)]
    got = score_quality(frame, spark.createDataFrame(labels, LABELS))
    assert got.columns == ["doc_id", "lang", "source", "_row", "a.b", "text", "held_out", "score", "predicted"]
    out = got.collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out) == sorted((r[0] or -1, r[1] or "") for r in rows)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    texts = {}
    for r in out:
        assert texts.setdefault(r["text"] or "", r["score"]) == r["score"]


def test_no_labels_one_class_no_rows(spark):
    frame = edges.frame(spark)
    none = score_quality(frame, spark.createDataFrame([], LABELS)).collect()
    assert {r["score"] for r in none} == {0.5} and {r["predicted"] for r in none} == {1}
    for value in (0, 1):
        one = [(r[0], value, 0) for r in edges.documents()]
        got = score_quality(frame, spark.createDataFrame(one, LABELS)).collect()
        assert {r["score"] for r in got} == {float(value)}
    assert score_quality(edges.empty(spark), spark.createDataFrame([], LABELS)).collect() == []
    # labels in the training part alone, and in the calibrating part alone
    for wanted in (True, False):
        part = [
            (r[0], r[0] % 2, 0) for r in edges.documents()
            if (zlib.crc32(str(r[0]).encode()) % 5 == kq.CALIBRATION) != wanted
        ]
        got = score_quality(frame, spark.createDataFrame(part, LABELS)).collect()
        assert all(0 <= r["score"] <= 1 for r in got)
