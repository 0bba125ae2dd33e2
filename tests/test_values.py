from decimal import Decimal

import pytest

from keylink import Params, Source, Workspace
from keylink.functions.canonical import join_key
from keylink.functions.frames import md5_of
from keylink.operators import candidates, values
from keylink.operators.profile import column_profile, with_uniqueness
from pyspark.sql import functions as F


def test_value_identity_across_types(spark, links):
    base = spark.range(1, 6)
    tables = {
        "ints": base.selectExpr("CAST(id AS INT) AS a"),
        "bigs": base.selectExpr("id AS b"),
        "texts": base.selectExpr("CAST(id AS STRING) AS c"),
        "decimals": base.selectExpr("CAST(id AS DECIMAL(10,2)) AS d"),
        "doubles": base.selectExpr("CAST(id AS DOUBLE) AS e"),
        "double_texts": base.selectExpr("CAST(CAST(id AS DOUBLE) AS STRING) AS f"),
    }
    found = links(tables)
    exact = ["ints.a", "bigs.b", "texts.c", "decimals.d"]
    expected = {(x, y) for x in exact for y in exact if x != y}
    expected |= {("doubles.e", "double_texts.f"), ("double_texts.f", "doubles.e")}
    assert set(found) == expected


@pytest.mark.parametrize(
    ("sql", "text"),
    [
        ("CAST('5.00' AS DECIMAL(10,2))", "5"),
        ("CAST('5.10' AS DECIMAL(10,2))", "5.1"),
        ("CAST('100' AS DECIMAL(10,0))", "100"),
        ("CAST('0.00' AS DECIMAL(10,2))", "0"),
        ("CAST('12345678901234567890123456789.50' AS DECIMAL(38,2))",
         "12345678901234567890123456789.5"),
        ("CAST(-0.0 AS DOUBLE)", "0.0"),
        ("CAST(7 AS TINYINT)", "7"),
        ("' a '", " a "),
        ("DATE '2024-01-31'", "2024-01-31"),
        ("true", "true"),
        ("CAST(NULL AS STRING)", None),
    ],
)
def test_canonical_text(spark, sql, text):
    frame = spark.sql(f"SELECT {sql} AS x")
    assert frame.selectExpr(join_key("x", frame.schema["x"].dataType)).first()[0] == text


def test_long_texts_are_told_apart_by_their_whole_content(spark, links):
    long = "x" * 100_000
    tables = {
        "a": spark.createDataFrame([(long + "1",), (long + "2",)], "v string"),
        "b": spark.createDataFrame([(long + "1",), (long + "3",)], "v string"),
        "c": spark.createDataFrame([(long + "2",)], "v string"),
    }
    assert set(links(tables)) == {("c.v", "a.v")}


def test_a_digest_is_never_taken_for_a_short_text(spark, table):
    long = "y" * 65
    digest = table("v string", [(long,)]).selectExpr(f"{join_key('v', _string())} AS v").first()[0]
    assert len(digest) > 64
    short = table("v string", [(digest,)]).selectExpr(f"{join_key('v', _string())} AS v").first()[0]
    assert short != digest  # a stored text that looks like a digest is digested itself


def _string():
    from pyspark.sql.types import StringType

    return StringType()


def test_odd_column_names(spark, links):
    tables = {
        "a": spark.range(5).withColumnRenamed("id", "we`ird na.me"),
        "b": spark.range(3).withColumnRenamed("id", "select"),
    }
    assert set(links(tables)) == {("b.select", "a.we`ird na.me")}


POLICY_ROWS = [
    # id, ascii_u, uni_u, ascii_d, uni_d, nul
    (i, f"a{i}", f"é{i}", "xy"[i % 2], "éè"[i % 2], None if i == 0 else f"n{i}")
    for i in range(10)
]
POLICY_SCHEMA = (
    "id int, ascii_u string, uni_u string, ascii_d string, uni_d string, nul string"
)


@pytest.mark.parametrize(
    ("policy", "both", "pk", "fk"),
    [
        ("any", True, {"id", "ascii_u", "uni_u"},
         {"id", "ascii_u", "uni_u", "ascii_d", "uni_d", "nul"}),
        ("any", False, {"id", "ascii_u", "uni_u"}, {"ascii_d", "uni_d", "nul"}),
        ("unique_only", True, {"id", "ascii_u", "uni_u"}, {"id", "ascii_u", "uni_u"}),
        ("unique_only", False, {"id", "ascii_u", "uni_u"}, set()),
        ("ascii", True, {"id", "ascii_u"}, {"id", "ascii_u", "ascii_d"}),
        ("ascii", False, {"id", "ascii_u"}, {"ascii_d"}),
    ],
)
def test_candidate_policies(spark, table, policy, both, pk, fk):
    source = Source("db", {"t": table(POLICY_SCHEMA, POLICY_ROWS)})
    meta = source.columns_frame(spark).select("cid", "column_name", "is_text")
    counts = values.value_counts(source, values.key_columns(source), text_stats=True)
    rows = candidates.classify(column_profile(counts).join(meta, "cid"), policy, both).collect()
    assert {r["column_name"] for r in rows if r["pk"]} == pk
    assert {r["column_name"] for r in rows if r["fk"]} == fk


def test_profile_numbers(spark, table):
    rows = [("a",), ("a",), ("é",), (None,), ("",)]
    source = Source("db", {"t": table("v string", rows)})
    counts = values.value_counts(source, values.key_columns(source), text_stats=True)
    row = with_uniqueness(column_profile(counts)).first()
    assert (row["row_count"], row["non_null"], row["distinct_values"], row["groups"]) == (5, 4, 3, 4)
    assert (row["blanks"], row["ascii_rows"], row["len_sum"]) == (2, 3, 7)
    assert row["is_unique"] is False


def test_sample_repeats_and_grows_to_the_whole(spark):
    frame = spark.range(25_000).selectExpr("id", "CAST(id % 7 AS STRING) AS t", "id * 1.5D AS d")
    space = Workspace(spark)
    first = values.column_sample(frame, 500, 25_000, space).collect()
    again = values.column_sample(frame.repartition(13), 500, 25_000, space).collect()
    unfiltered = values.column_sample(frame, 500).collect()
    assert sorted(first) == sorted(again) == sorted(unfiltered)
    assert values.column_sample(frame, 30_000, 25_000, space).count() == 25_000


def test_sample_when_one_key_fills_the_table(spark):
    # A third of the rows are copies, so the hash cut may catch too few rows.
    frame = spark.range(9_000).selectExpr("IF(id % 3 = 0, 7, id) AS k")
    expected = [
        r["k"] for r in frame.orderBy(md5_of([F.col("k")])).limit(50).collect()
    ]
    space = Workspace(spark)
    got = [r["k"] for r in values.column_sample(frame, 50, 9_000, space).collect()]
    assert sorted(got) == sorted(expected)
    same = spark.range(5_000).selectExpr("1 AS k")
    assert values.column_sample(same, 50, 5_000, space).count() == 50


def test_sampled_discovery_equals_full_scan_when_the_sample_is_everything(spark, links):
    tables = {
        "k": spark.range(1_000),
        "f": spark.range(5_000).selectExpr("id % 900 AS x", "id % 1100 AS y"),
    }
    whole = links(tables, Params.ungated(sup_out_foreign_key=0.5))
    sampled = links(tables, Params.ungated(sup_out_foreign_key=0.5, sample_rows=10_000))
    assert whole == sampled
    assert ("f.x", "k.id") in whole


def test_decimal_join_key_without_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        frame = spark.createDataFrame([(Decimal("0E-10"),), (Decimal("0.0000001000"),)],
                                      "x decimal(20,10)")
        got = [r[0] for r in frame.selectExpr(join_key("x", frame.schema["x"].dataType)).collect()]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert got == ["0", "0.0000001"]


def test_helper_columns_never_clash(table):
    from keylink.operators.inclusion import matched_rows
    from keylink.operators.values import column_sample

    frame = table("_h string, _key long", [("a", 1), ("b", 2), ("c", 3)])
    assert column_sample(frame, 2).columns == ["_h", "_key"]
    assert matched_rows(frame, "_key", table("k long", [(2,)]), "k").collect()[0]["_h"] == "b"
