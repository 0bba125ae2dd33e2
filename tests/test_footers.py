"""Statistics out of Parquet footers."""

import pytest

from keylink import Params, Source, discover
from keylink.operators.values import key_columns
from keylink.sources import footers
from keylink.sources.catalog import files_source


@pytest.fixture
def shop(spark, tmp_path):
    spark.range(100).selectExpr(
        "id AS k", "CAST(id % 5 AS INT) AS few", "IF(id = 3, NULL, id) AS gap", "concat('n', id) AS name",
        "IF(id = 3, NULL, current_date()) AS day",
    ).write.parquet(f"{tmp_path}/t.parquet")
    spark.range(50).selectExpr("id % 20 AS f").write.parquet(f"{tmp_path}/r.parquet")
    spark.range(30).selectExpr("id AS u").write.parquet(f"{tmp_path}/u.parquet")
    spark.range(0).selectExpr("id AS nothing").write.parquet(f"{tmp_path}/e.parquet")
    return files_source(spark, str(tmp_path))


def plan(frame):
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)


def test_counts_and_ranges_come_from_footers(spark, shop):
    columns = key_columns(shop)
    found, rest = footers.from_footers(spark, shop, columns)
    assert rest == []
    named = {c.cid: c.name for c in columns}
    assert {named[r[0]]: r[1:] for r in found} == {
        "k": (100, 100, 0, 99), "few": (100, 100, 0, 4), "gap": (100, 99, 0, 99),
        "name": (100, 100, None, None), "day": (100, 99, None, None), "f": (50, 50, 0, 19),
        "nothing": (0, 0, None, None), "u": (30, 30, 0, 29),
    }
    asked = footers.footer_query(
        footers.footer_session(spark), shop.parquet_path("t"), [c for c in columns if c.table == "t"]
    )
    text = plan(asked)
    assert "PushedAggregation: [COUNT(*), COUNT(k), MIN(k), MAX(k)" in text
    assert "ReadSchema: struct<k" not in text
    # the caller's session reads as before
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    assert {named[r[0]] for r in found if footers.no_key(r)} == {"few", "gap", "day", "f"}


def test_other_tables_are_scanned(spark, shop):
    half = shop.tables["t"].filter("k < 50")
    source = Source("db", {**shop.tables, "t": half, "local": spark.range(7)}, stored=shop.stored)
    assert source.parquet_path("t") is None and source.parquet_path("r") is not None
    columns = key_columns(source)
    _, rest = footers.from_footers(spark, source, columns)
    assert {c.table for c in rest} == {"t", "local"}
    named = {c.cid: (c.table, c.name) for c in columns}
    rows = {named[r[0]]: tuple(r)[1:] for r in footers.counts_and_ranges(spark, source, columns).collect()}
    assert rows["t", "k"] == (50, 50, 0, 49) and rows["local", "id"] == (7, 7, 0, 6)
    assert rows["r", "f"] == (50, 50, 0, 19) and rows["t", "name"] == (50, 50, None, None)


def test_files_without_statistics_are_scanned(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"a": [1, 2, 2]}), f"{tmp_path}/bare.parquet", write_statistics=False)
    source = files_source(spark, str(tmp_path))
    rows = footers.counts_and_ranges(spark, source, key_columns(source)).collect()
    assert [tuple(r) for r in rows] == [(0, 3, 3, 1, 2)]


@pytest.mark.parametrize("options", [{"class_policy": "unique_only"}, {"sample_rows": 30}])
def test_discovery_is_the_same_with_footers(spark, shop, options):
    params = Params.ungated(**options)
    plain = Source(shop.db, {name: frame.select("*") for name, frame in shop.tables.items()})
    results = [
        sorted(map(tuple, discover(spark, source, params, strategy=strategy).collect()))
        for source in (shop, plain) for strategy in ("auto", "oneshot")
    ]
    assert results[0] and all([r[3:5] + r[8:] for r in x] == [r[3:5] + r[8:] for r in results[0]] for x in results)
