"""Samples of many tables in one job against the sample of each table."""

from dataclasses import replace

import pytest

from keylink import Params, Source, Workspace
from keylink.operators.samples import expected_cut, sampled_counts
from keylink.operators.values import column_sample, key_columns, value_counts


@pytest.fixture
def source(spark):
    base = spark.range(5000)
    return Source(
        "db",
        {
            "plain": base.selectExpr("id", "id % 9 AS few", "concat('t', id % 70) AS tid", "id / 7D AS h"),
            "short": spark.range(40).selectExpr("id", "CAST(id AS STRING) AS cells"),
            "nearly": spark.range(101).selectExpr("id * 3 AS id"),
            # copies of one row, told apart by a double alone, straddle the last place
            "copies": base.selectExpr("IF(id % 3 = 0, 7, id) AS k", "CAST(id AS DOUBLE) AS d"),
            "all_copies": base.selectExpr("1 AS one", "CAST(id % 50 AS DOUBLE) AS d"),
            "reals": base.selectExpr("CAST(id AS DOUBLE) / 8 AS only"),
            "empty": spark.range(0).selectExpr("id AS none"),
        },
    )


@pytest.mark.parametrize("rows", [1, 100, 1000])
def test_counts_equal_those_of_each_sample(spark, source, rows):
    columns = key_columns(source)
    total = {t: f.count() for t, f in source.tables.items()}
    hashed = {t: f.columns for t, f in source.tables.items()}
    done = sampled_counts(source, columns, hashed, rows, total, Workspace(spark))
    sampled = {t: column_sample(f, rows) for t, f in source.tables.items()}
    expected = value_counts(replace(source, tables=sampled), columns).collect()
    settled = {c.cid for c in columns if c.table not in done.unsettled}
    got = sorted(map(tuple, done.counts.select("cid", "v", "cnt").collect()), key=str)
    assert got == sorted(
        ((r["cid"], r["v"], r["cnt"]) for r in expected if r["cid"] in settled), key=str
    )
    assert "plain" not in done.unsettled and "short" not in done.unsettled
    assert "all_copies" in done.unsettled


@pytest.mark.parametrize("strategy", ["auto", "staged", "oneshot"])
def test_discovery_on_samples_with_unsettled_tables(spark, source, links, strategy):
    params = Params.ungated(sample_rows=100, sup_out_foreign_key=0.4)
    found = links(source.tables, params, strategy=strategy)
    assert ("plain.few", "nearly.id") in found or ("plain.few", "short.id") in found
    longer = Params.ungated(sample_rows=100, sup_out_foreign_key=0.4, use_str_len=True)
    assert links(source.tables, longer, strategy=strategy) == found


def test_cut():
    assert expected_cut(10, 10) == "g" and expected_cut(100, 10_000_000) < "00020000"
    assert "ffffffff" < "g"
