import random

import edges
from keylink.sources.workspace import Workspace
from pyspark.sql import functions as F


def test_stages_keep_their_contracts(spark, tmp_path):
    import corpus_pipeline as p

    frame = edges.frame(spark).select(*p.COLUMNS)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality_rules", "near_dedup", "personal_data", "mixing", "packing"]
    for n, (name, stage) in enumerate(p.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(p.COLUMNS)
        assert out.filter(F.length("text") != F.col("n_chars")).count() == 0
        out.write.parquet(f"{tmp_path}/{n}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{n}")
        if name == "near_dedup":
            assert docs.select("doc_id").distinct().count() == docs.count() <= before.count()
    pieces = p.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
    assert all(len(r["ids"]) == r["length"] for r in pieces)
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


def test_empty_documents(spark, tmp_path):
    import corpus_pipeline as p

    edges.empty(spark).select(*p.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []


def test_near_dedup_links_pairs_from_80_percent(spark):
    import corpus_pipeline as p

    rng = random.Random(8)
    rows, expected = [], set()
    # of two documents of 100 shingles, each has the same number of its own at the end
    for pair, own in enumerate((11, 10, 9, 12, 14)):
        shared = edges.words(rng, 104 - own, 10**6)
        share = (100 - own) / (100 + own)
        rows += [(2 * pair + i, f"{shared} {edges.words(rng, own, 10**6)}") for i in (0, 1)]
        expected |= {2 * pair} if share >= 0.8 else {2 * pair, 2 * pair + 1}
    assert expected == {0, 2, 4, 6, 7, 8, 9}
    docs = edges.frame(spark, [(i, t, "en", "s", len(t), *edges.CLASH) for i, t in rows]).select(*p.COLUMNS)
    got = dict(p.STAGES)["near_dedup"](spark, docs, "")
    assert {r["doc_id"] for r in got.collect()} == expected


def test_first_stages_leave_no_texts_in_scratch_tables(spark, tmp_path, monkeypatch):
    """Repeated rows, null ids and null hosts among them; no table that a stage writes has a text in it."""
    import corpus_pipeline as p

    rng, saved, save = random.Random(4), [], Workspace.save
    texts = [edges.words(rng, 80) for _ in range(6)]
    rows = [(i % 5, texts[i % 6], "en", None if i % 4 == 0 else "s", i, *edges.CLASH) for i in range(24)]
    rows += [(None, texts[0], "en", "s", i, *edges.CLASH) for i in range(2)] + [(50, None, "en", None, 0, *edges.CLASH)]
    docs = edges.frame(spark, rows).select(*p.COLUMNS)

    def recording(self, frame, name):
        saved.append((name, [c for c, kind in frame.dtypes if kind == "string"]))
        return save(self, frame, name)

    monkeypatch.setattr(Workspace, "save", recording)
    kept = p.quality_rules(spark, docs, "")
    assert kept.count() == 26
    out = p.near_dedup(spark, kept, "").collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == [0, 1]
    assert sum(r["doc_id"] is None for r in out) == 2
    assert {c for _, names in saved for c in names} <= {"_host"}
