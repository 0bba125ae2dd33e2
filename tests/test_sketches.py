"""Sketches and rounds: nothing right is ever ruled out, and much that is wrong is."""

import random

import pytest
from pyspark.sql import functions as F

from keylink import Params, Source, Workspace, discover
from keylink.functions.frames import metadata_frame
from keylink.operators import inclusion, rounds, sketches, values
from keylink.plans import discover as plan
from keylink.sources.catalog import files_source


def random_tables(spark, seed, tables=6, rows=400):
    rng = random.Random(seed)
    made = {}
    for t in range(tables):
        n = rng.randint(rows // 2, rows)
        low = rng.randint(0, 50)
        columns = {
            f"k{t}": list(range(low, low + n)),
            f"f{t}": [rng.randint(0, rows) for _ in range(n)],
            f"s{t}": [rng.choice(["", "a", "b", None]) for _ in range(n)],
            f"u{t}": [f"t{i * rng.randint(1, 3)}" for i in range(n)],
            f"n{t}": [None if rng.random() < 0.02 else i % 97 for i in range(n)],
        }
        names = list(columns)
        made[f"t{t}"] = metadata_frame(
            spark, list(zip(*columns.values(), strict=True)),
            ", ".join(f"{c} {'string' if c[0] in 'su' else 'int'}" for c in names),
        )
    return made


def brute(tables, sup):
    cells = {
        (t, c): [None if r[c] is None else str(r[c]) for r in frame.select(c).collect()]
        for t, frame in tables.items() for c in frame.columns
    }
    keys = {x: set(v) for x, v in cells.items() if None not in v and len(set(v)) == len(v)}
    return {
        (f, k)
        for f, v in cells.items() for k, held in keys.items()
        if f[0] != k[0] and sum(x not in held for x in v) / len(v) <= sup
    }, keys


@pytest.mark.parametrize("sup", [0.0, 0.03, 0.5])
@pytest.mark.parametrize("size", [16, 64, 10_000])
def test_refuted_pairs_are_wrong_ones(spark, sup, size):
    tables = random_tables(spark, seed=size)
    source = Source("db", tables)
    columns = values.key_columns(source)
    named = {c.cid: (c.table, c.name) for c in columns}
    space = Workspace(spark)
    stats = space.save(sketches.column_statistics(source, columns), "statistics")
    judged = stats.select("cid", "row_count", sketches.may_be_unique(), sketches.distinct_estimate()).collect()
    estimates = {r[0]: r[3] for r in judged}
    sketch = space.save(sketches.column_sketches(source, columns, estimates, size), "sketches")
    repeated = {r["cid"] for r in sketch.filter(sketches.repeats()).collect()}
    possible = [r[0] for r in judged if r[2] and r[0] not in repeated]
    right, keys = brute(tables, sup)
    assert {named[cid] for cid in possible} >= set(keys)
    counts = {r[0]: float(r[1]) for r in judged}
    left = sketches.surviving_pairs(
        spark, sketch, stats, [(c.cid, c.table, counts[c.cid]) for c in columns],
        [(c.cid, c.table) for c in columns if c.cid in possible], sup,
    ).collect()
    survived = {(named[r["fk"]], named[r["pk"]]) for r in left}
    assert len(survived) == len(left)
    assert survived >= {(f, k) for f, k in right}
    everything = sum(named[a][0] != named[b][0] for a in named for b in possible)
    if sup == 0:  # a few values can't prove that half of the rows miss
        assert len(survived) < everything
    if size == 10_000:  # columns kept whole: what survives is right, keys apart
        assert {(f, k) for f, k in survived if k in keys} == right


def test_sketches_merge(spark):
    tables = random_tables(spark, seed=2, tables=2)
    halves = [
        Source("db", {t: f.filter(f"{c}{t[1:]} % 2 = {half}") for t, f in tables.items() for c in "k"})
        for half in (0, 1)
    ]
    whole = Source("db", tables)
    columns = values.key_columns(whole)
    estimates = {c.cid: 300 for c in columns}
    merged = sketches.merge_sketches(
        sketches.column_sketches(halves[0], columns, estimates, 50)
        .unionByName(sketches.column_sketches(halves[1], columns, {k: 200 for k in estimates}, 50))
    )
    alone = sketches.column_sketches(whole, columns, estimates, 50)
    assert {r["cid"]: (r["cut"], r["entries"]) for r in merged.collect()} == {
        r["cid"]: (r["cut"], r["entries"]) for r in alone.collect()
    }
    parts = [sketches.column_statistics(h, columns) for h in halves]
    one = sketches.merge_statistics(parts[0].unionByName(parts[1]))
    shown = ["cid", "row_count", "non_null", "low_int", "high_int", "low_text", "high_text"]
    estimate = sketches.distinct_estimate().alias("estimate")
    got = {r["cid"]: r for r in one.select(*shown, estimate).collect()}
    for r in sketches.column_statistics(whole, columns).select(*shown, estimate).collect():
        assert got[r["cid"]] == r


def test_empty_texts_and_single_rows_stay_possible_keys(spark):
    tables = {
        "one": metadata_frame(spark, [("",)], "a string"),
        "few": metadata_frame(spark, [("",), ("x",), ("y",)], "b string"),
        "null": metadata_frame(spark, [(None,), ("x",)], "c string"),
    }
    source = Source("db", tables)
    stats = sketches.column_statistics(source, values.key_columns(source))
    assert [r[0] for r in stats.orderBy("cid").select(sketches.may_be_unique()).collect()] == [
        True, True, False,
    ]


@pytest.fixture
def shop(spark, tmp_path):
    keys = spark.range(4000)
    keys.selectExpr("id AS k").write.parquet(f"{tmp_path}/keys.parquet")
    spark.range(3000).selectExpr(
        "id % 1500 AS good",
        "IF(id % 2 = 0, id % 1500, id % 1500 + 100000) AS bad",  # half of the rows miss
        "IF(id % 1500 = 7, 900000, id % 1500) AS late",  # one value in 1,500 misses
    ).write.parquet(f"{tmp_path}/refs.parquet")
    return files_source(spark, str(tmp_path))


def test_dead_columns_leave_the_later_scans(spark, shop, monkeypatch):
    """Sketches off: the rounds alone find out, and stop reading what is dead."""
    seen = []
    plain = values.value_counts

    def spy(source, columns, text_stats=False, rows=None, slots=None):
        frame = plain(source, columns, text_stats, rows, slots)
        if slots not in (None, (0, values.SLOTS)):
            schema = [x.split("ReadSchema: ")[1].split("\n")[0] for x in plan_text(frame).split("\n") if "ReadSchema" in x]
            seen.append((slots, sorted(c.name for c in columns), schema))
        return frame

    def plan_text(frame):
        return frame._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )

    monkeypatch.setattr(plan, "value_counts", spy)
    monkeypatch.setattr(plan, "surviving_pairs", lambda spark, s, st, refs, keys, sup, w: metadata_frame(
        spark, [(r[0], k[0]) for r in refs for k in keys if r[1] != k[1]], "fk int, pk int"))
    found = discover(spark, shop, Params.ungated(), strategy="staged").collect()
    assert {(r["table2"], r["column2"]) for r in found} == {("refs", "good")}
    assert seen[0][1] == ["bad", "good", "late"] and seen[0][0] == rounds.ROUNDS[0]
    assert seen[-1][0] == rounds.ROUNDS[-1] and "bad" not in seen[-1][1]
    assert all("bad" not in schema for schema in seen[-1][2]) and "good" in "".join(seen[-1][2])


def test_rounds_count_each_value_once(spark, shop):
    columns = [c for c in shop.columns() if c.table == "refs"]
    whole = values.value_counts(shop, columns).select("cid", "v", "cnt")
    parts = [
        values.value_counts(shop, columns, slots=slots).select("cid", "v", "cnt", "slot")
        for slots in rounds.ROUNDS
    ]
    got = sorted((r["cid"], r["v"], r["cnt"]) for part in parts for r in part.collect())
    assert got == sorted(tuple(r) for r in whole.collect())
    for slots, part in zip(rounds.ROUNDS, parts, strict=True):
        assert all(slots[0] <= r["slot"] < slots[1] for r in part.collect())


def test_long_texts_and_nulls_have_one_slot_on_both_sides(spark, links):
    texts = [("x" * 70 + str(i),) for i in range(300)]
    refs = [(t,) for (t,) in texts for _ in range(2)] + [(None,)]
    tables = {
        "k": metadata_frame(spark, texts, "k string"), "f": metadata_frame(spark, refs, "f string"),
    }
    for sup, expected in ((0.0, set()), (0.01, {("f.f", "k.k")})):
        params = Params.ungated(sup_out_foreign_key=sup)
        assert set(links(tables, params, strategy="staged")) - {("k.k", "f.f")} == expected
        assert set(links(tables, params, strategy="oneshot")) - {("k.k", "f.f")} == expected


# -- prefix tree --------------------------------------------------------------------


def nested(spark, n, seen=2):
    """Column i holds the values 0 to i, ``seen`` rows each; all columns are keys and refer."""
    return spark.range(n).select(
        F.col("id").cast("string").alias("v"),
        F.explode(F.sequence(F.col("id").cast("int"), F.lit(n - 1))).alias("cid"),
        F.lit(seen).cast("bigint").alias("cnt"), F.lit(True).alias("is_pk"),
    )


class Counting(Workspace):
    def save(self, frame, name):
        saved = super().save(frame, name)
        self.rows = {**getattr(self, "rows", {}), name: max(self.rows.get(name, 0) if hasattr(self, "rows") else 0, saved.count())}
        return saved


def test_three_hundred_nested_keys(spark, monkeypatch):
    monkeypatch.setattr(inclusion, "TREE_FROM_ROWS", 1)
    n = 300
    space = Counting(spark)
    hits = inclusion.hits_by_pair(nested(spark, n), n, space).collect()
    assert len(hits) == n * n
    assert all(r["hits"] == 2 * (min(r["fk"], r["pk"]) + 1) for r in hits)
    # distinct sets and nodes grow with the keys, sums with their square; spread-out sets would
    # be 9 million rows
    assert space.rows["paths"] == n and space.rows["nodes"] == n
    assert max(space.rows.values()) <= n * n


def test_tree_equals_spread_out_sets(spark, monkeypatch):
    rng = random.Random(6)
    rows = [
        (str(v), c, rng.randint(1, 4) if rng.random() < 0.7 else None, rng.random() < 0.6)
        for v in range(150) for c in rng.sample(range(30), rng.randint(1, 14))
    ] + [(None, 3, 5, True)]
    frame = spark.createDataFrame(rows, "v string, cid int, cnt bigint, is_pk boolean")
    plain = {tuple(r) for r in inclusion.hits_by_pair(frame).collect()}
    assert plain == {tuple(r) for r in inclusion.hits_by_pair(frame, 64, Workspace(spark)).collect()}
    monkeypatch.setattr(inclusion, "TREE_FROM_ROWS", 1)
    assert plain == {tuple(r) for r in inclusion.hits_by_pair(frame, 64, Workspace(spark)).collect()}
    assert inclusion.hits_by_pair(frame.filter("false"), 64, Workspace(spark)).collect() == []
