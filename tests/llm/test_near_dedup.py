import random
import re

import edges
import numpy as np
import pytest
from keylink.llm import near_dedup
from keylink.llm.components import components
from keylink.llm.near_dedup import near_duplicates
from keylink.sources.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(rows):
    """{id: (size, component)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 85 * max(len(x), len(y)):
                if 100 * len(x & y) >= 85 * len(x | y):
                    one, two = sorted((find(a), find(b)))
                    parent[two] = one
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(frame, rows):
    got = near_duplicates(frame).collect()
    assert len(got) == len(rows)
    expected = brute(rows)
    for r in got:
        size, component = expected[r["doc_id"]]
        assert (r["n_shingles"], r["component_id"]) == (size, component), r["doc_id"]
        assert r["kept"] == (r["doc_id"] == component)


def test_same_as_all_pairs(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    check(edges.frame(spark), [r[:2] for r in edges.documents()])


@pytest.mark.parametrize("leaf", [(2, 4), (32, 1024)])
def test_chains_and_large_groups(spark, monkeypatch, leaf):
    """A group of near copies larger than a leaf, a chain, and documents around the threshold."""
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    rng = random.Random(3)
    base = edges.words(rng, 150).split(" ")
    texts = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(150)] = f"edit{i}"
        texts.append(" ".join(own))
    chain = edges.words(rng, 120).split(" ")
    for _ in range(25):
        chain = list(chain)
        chain[rng.randrange(120)] = f"n{rng.random()}"
        texts.append(" ".join(chain))
    passage = edges.words(rng, 60)
    texts += [f"{passage} {edges.words(rng, rng.randrange(1, 40))}" for _ in range(80)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    frame = edges.frame(spark, [(i, t, "en", "s", 0, *edges.CLASH) for i, t in rows])
    check(frame, rows)


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = "one two three four five six"
    rows = [(4, text), (4, text), (2, text), (2, text), (None, text), (None, None), (9, None), (8, "")]
    frame = edges.frame(spark, [(i, t, "en", "s", 0, *edges.CLASH) for i, t in rows])
    got = near_duplicates(frame).collect()
    assert sorted(r["component_id"] for r in got if r["doc_id"] in (2, 4)) == [2] * 4
    assert sum(r["kept"] for r in got if r["doc_id"] in (2, 4)) == 2
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in got if r["doc_id"] not in (2, 4))
    once = near_duplicates(frame, one_row=True).collect()
    assert sum(r["kept"] for r in once if r["doc_id"] in (2, 4)) == 1
    assert near_duplicates(edges.empty(spark)).collect() == []


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    rng.shuffle(links)
    frame = spark.createDataFrame(links, "u long, v long")
    found = {r["u"]: r["v"] for r in components(frame, Workspace(spark)).collect()}
    label = {n: n for e in links for n in e}
    for _ in range(100):
        for u, v in links:
            label[u] = label[v] = min(label[u], label[v])
    assert found == {n: m for n, m in label.items() if n != m}


def test_odd_sketches_differ_by_no_more_than_the_sets():
    rng = np.random.default_rng(3)
    for common, own in ((0, 1), (40, 5), (300, 60), (3000, 400)):
        parts = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (common, own, own // 2)]
        sets = [np.concatenate([parts[0], x]) for x in (*parts[1:], parts[0][:0])]
        sketches = near_dedup._odd_sketch(np.concatenate(sets), np.array([len(x) for x in sets]))
        a, b, c = sketches.reshape(3, near_dedup.SKETCH)
        apart = lambda x, y: sum(int(z).bit_count() for z in x ^ y)
        assert apart(a, b) <= own + own // 2
        assert apart(a, c) <= own
        assert apart(a, a) == 0
    assert len(near_dedup._odd_sketch(sets[0][:0], np.zeros(2, dtype=np.int64))) == 2 * near_dedup.SKETCH


def test_percent_binds_links_and_screens():
    assert [near_dedup._children(p) for p in (85, 80)] == [2, 3]
    assert [near_dedup._max_different(p) for p in (85, 80)] == [24, 28]


def test_rounds_hold_the_chance_at_every_depth():
    assert [near_dedup._rounds(85, d) for d in (0, 1, 2, 5, 10)] == [1, 1, 2, 3, 5]
    for percent in (80, 85):
        for d in range(30):
            assert near_dedup._missed(percent, d) ** near_dedup._rounds(percent, d) <= near_dedup.MISS


def test_template_family_larger_than_a_leaf(spark, monkeypatch):
    """Unlinked documents on one template, which branch for several steps, with some pairs above 85 %."""
    monkeypatch.setattr(near_dedup, "LEAF", (8, 32))
    monkeypatch.setattr(near_dedup, "MISS", 1e-6)  # a second round from one step on
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    turns = []
    renewed = near_dedup._renewed
    monkeypatch.setattr(near_dedup, "_renewed", lambda *a: turns.append(a[3]) or renewed(*a))
    rng = random.Random(9)
    template, texts = edges.words(rng, 200, 10**6), []
    for _ in range(40):
        texts.append(f"{template} {edges.words(rng, 36, 10**6)}")
    for text in texts[:5]:
        texts.append(f"{text} {edges.words(rng, 10, 10**6)}")
    rows = list(enumerate(texts))
    frame = edges.frame(spark, [(i, t, "en", "s", 0, *edges.CLASH) for i, t in rows])
    check(frame, rows)
    assert turns and turns[0] == 1


def test_full_sets_of_candidates_only(spark, monkeypatch):
    """Texts that share a passage meet in nodes, but their sets are fetched only where they may be near."""
    made, save = {}, Workspace.save
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"{passage} " + " ".join(f"o{i}x{j}" for j in range(60)), None, None, 1, *edges.CLASH) for i in range(25)]
    rows += [(i + 100, f"{rows[i][1]} more", *rows[i][2:]) for i in range(3)]
    rows += [(5, rows[0][1], *rows[0][2:]), *[(200, rows[i][1], *rows[i][2:]) for i in (0, 0, 9)]]

    def counting(self, frame, name):
        saved = save(self, frame, name)
        made.setdefault(name, []).append(saved.count())
        return saved

    monkeypatch.setattr(Workspace, "save", counting)
    got = near_duplicates(edges.frame(spark, rows)).collect()
    linked = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] not in (5, 200)}
    assert linked == {**{i: i for i in range(25) if i != 5}, **{i + 100: i for i in range(3)}}
    assert len(got) == len(rows)
    assert sum(made["full"]) == 6 and made["nodes"][0] > 25


def test_texts_that_share_a_passage_alone_do_not_branch(spark, monkeypatch):
    """A fifth of each set is common to all; by one token, 285 members of root nodes had to branch."""
    monkeypatch.setattr(near_dedup, "LEAF", (8, 32))
    members, branch = [], near_dedup._branch

    def counting(rows, open_, percent):
        members.append(rows.join(open_.select("node"), "node").count())
        return branch(rows, open_, percent)

    monkeypatch.setattr(near_dedup, "_branch", counting)
    rng = random.Random(12)
    passage = edges.words(rng, 20, 10**6)
    texts = [f"{passage} {edges.words(rng, 60, 10**6)}" for _ in range(120)]
    texts += [f"{text} {edges.words(rng, 2, 10**6)}" for text in texts[:4]]
    rows = list(enumerate(texts))
    frame = edges.frame(spark, [(i, t, "en", "s", 0, *edges.CLASH) for i, t in rows])
    check(frame, rows)
    assert sum(members) == 0
