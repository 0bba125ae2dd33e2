"""Steps of the plan for large data: what they evaluate per cell and how often they shuffle."""

import re

import pytest

from keylink.functions.frames import metadata_frame
from keylink.operators import rounds, sketches, values
from keylink.sources.catalog import Source
from keylink.sources.workspace import Workspace


@pytest.fixture
def source(spark):
    frame = spark.range(600).selectExpr(
        "id % 50 AS i",
        "IF(id % 7 = 0, NULL, CAST(id % 40 AS double) / 4) AS d",
        "CAST(id % 30 AS decimal(9,2)) / 8 AS p",
        "timestampadd(DAY, CAST(id % 20 AS int), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS t",
        "concat('x', id % 60) AS s",
    )
    return Source("db", {"a": frame})


def plan_text(frame):
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)


def test_statistics_hash_below_the_aggregation(source):
    plan = plan_text(sketches.column_statistics(source, values.key_columns(source)))
    sketched = re.findall(r"hll_sketch_agg\(([^,]*),", plan)
    assert sketched and all(re.fullmatch(r"x\d+#\d+L?", x) for x in sketched)


def test_sketches_do_not_depend_on_the_grouping(source, monkeypatch):
    columns = values.key_columns(source)
    estimates = {c.cid: 100_000 if c.name == "i" else 60 for c in columns}
    grouped = sketches.column_sketches(source, columns, estimates, 40)
    assert sorted(c.name for c in values.grouped_first(columns, estimates)) == ["d", "p", "t"]
    got = sorted(map(str, grouped.collect()))
    monkeypatch.setattr(values, "FEW_VALUES", 0)
    assert values.grouped_first(columns, estimates) == []
    assert got == sorted(map(str, sketches.column_sketches(source, columns, estimates, 40).collect()))


@pytest.mark.parametrize("slots", [(0, values.SLOTS), (8, values.SLOTS), (0, 8)])
def test_slots_after_the_grouping_are_those_of_the_cells(source, slots):
    columns = values.key_columns(source)
    got = values.value_counts(source, columns, table_rows={"a": 10**9}, slots=slots)
    expected = {}
    for c in columns:
        cells = source.tables["a"].selectExpr(f"{values.slot_of(c)} AS s", f"{values.join_key(c.name, c.dtype)} AS v")
        for s, v in cells.collect():
            if slots[0] <= s < slots[1]:
                expected[c.cid, v, s] = expected.get((c.cid, v, s), 0) + 1
    assert {(r["cid"], r["v"], r["slot"]): r["cnt"] for r in got.collect()} == expected


def test_rounds_shuffle_each_value_once(spark, monkeypatch):
    keys = [(cid, str(v), 1, v % 64) for cid in (0, 1) for v in range(100 * (cid + 1))]
    counts = metadata_frame(spark, keys, "cid int, v string, cnt bigint, slot bigint")
    plans, plain = [], rounds.hits_by_pair

    def spy(rows, *more):
        plans.append(plan_text(rows))
        return plain(rows, *more)

    monkeypatch.setattr(rounds, "hits_by_pair", spy)
    pairs = metadata_frame(spark, [(0, 1), (1, 0)], "fk int, pk int")
    tested = rounds.surviving_in_rounds(
        spark, pairs, None, [], counts, {0: 100.0, 1: 200.0}, 0.0, Workspace(spark)
    )
    assert [tuple(r) for r in tested.pairs.collect()] == [(0, 1, 100)]
    assert plans and all("Join" not in p and "Exchange" not in p for p in plans)


def test_rounds_that_can_refute_nothing_are_left_out():
    assert rounds.rounds_for(0.0) == rounds.ROUNDS
    assert rounds.rounds_for(0.05) == ((0, 8), (8, values.SLOTS))
    assert rounds.rounds_for(0.5) == ((0, values.SLOTS),)
    assert rounds.rounds_for(0.05, "fixed") == rounds.ROUNDS
