import random
import re
from collections import Counter, defaultdict

import edges
from keylink.llm.quality import QualityRules, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    ws = WORD.findall(text)
    grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    again = set()
    for i in range(len(ws) - 2):
        if grams[tuple(ws[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    failed = len(ws) < 50 or 100 * len(again) > 50 * len(ws)
    return (
        len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dups, len(again), failed
    )


COLUMNS = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()


def test_base_counts(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars"
    )
    for frame in (docs, edges.frame(spark)):
        texts = {r["doc_id"]: r["text"] for r in frame.collect()}
        got = quality(frame, with_text=False).collect()
        assert len(got) == len(texts)
        for r in got:
            assert tuple(r[c] for c in COLUMNS) == base(texts[r["doc_id"]]), r["doc_id"]


def normal(line):
    return " ".join(WORD.findall(re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), line))))


def test_lines_above_the_limit_go(spark):
    rules = QualityRules(min_docs=3, max_share=0.05)
    rows = edges.documents()
    got = {r["doc_id"]: r for r in quality(edges.frame(spark, rows), rules).collect()}
    # documents differ in their text here, so each counts unless it is a copy or a near copy
    docs = defaultdict(set)
    for i, text, _, host, *_ in rows:
        for line in (text or "").split("\n"):
            if WORD.search(line):
                docs[host, normal(line)].add(text)
    often = {k for k, v in docs.items() if len(v) >= 3}
    shared = "shared line of text here"
    assert any(k[1] == shared for k in often)
    for i, text, _, host, *_ in rows:
        r = got[i]
        lines = (text or "").split("\n")
        if text is None:
            assert r["clean_text"] is None and not r["kept"]
            continue
        if shared in lines and (host, shared) in often:
            assert r["clean_text"] == "\n".join(x for x in lines if x != shared)
            assert r["n_left"] == r["n_words"] - 5
        else:
            assert r["clean_text"] == text
        assert r["a.b"] == "clash" and r["_row"] == 7
        assert r["kept"] == (not r["base_failed"] and 2 * r["n_left"] >= r["n_words"])


def test_depleted_documents_are_rejected_and_copies_are_not(spark):
    rules = QualityRules(min_docs=5, max_share=0.01, min_words=10)
    rng = random.Random(5)
    notice = "\n".join(edges.words(rng, 8) for _ in range(12))
    rows = [(i, f"{edges.words(rng, 60)}\n{notice}", "en", "h", 0, *edges.CLASH) for i in range(40)]
    clean = "\n".join(edges.words(rng, 8) for _ in range(10))
    rows += [(100 + i, clean, "en", "h", 0, *edges.CLASH) for i in range(30)]
    got = {r["doc_id"]: r for r in quality(edges.frame(spark, rows), rules).collect()}
    assert all(got[i]["n_left"] == 60 and not got[i]["kept"] for i in range(40))
    assert all(got[100 + i]["kept"] for i in range(30))


def test_empty_table(spark):
    assert quality(edges.empty(spark)).collect() == []


def test_production_rules_count_distinct_documents_not_shared_passages(spark):
    """Documents that are nine tenths boilerplate go; near copies of a clean document stay."""
    rng = random.Random(6)
    notice = "\n".join(edges.words(rng, 9, 10**6) for _ in range(30))
    rows = [(i, f"{edges.words(rng, 30, 10**6)}\n{notice}", "en", "h", 0, *edges.CLASH) for i in range(40)]
    clean = [edges.words(rng, 10, 10**6).split(" ") for _ in range(30)]
    for i in range(60):
        own = [list(line) for line in clean]
        own[rng.randrange(30)][rng.randrange(10)] = f"edit{i}"
        rows.append((100 + i, "\n".join(map(" ".join, own)), "en", "h", 0, *edges.CLASH))
    got = {r["doc_id"]: r for r in quality(edges.frame(spark, rows)).collect()}
    assert all(got[i]["n_left"] == 30 and not got[i]["kept"] for i in range(40))
    assert all(got[100 + i]["kept"] and got[100 + i]["n_left"] == 300 for i in range(60))
