import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from keylink import Params, Source
from keylink.functions.frames import metadata_frame
from keylink.operators.inclusion import matched_rows, orphan_rows
from keylink.plans import discover

BOTH = ["oneshot", "staged"]


@pytest.fixture
def tables(spark):
    keys = [(i,) for i in range(20)]
    exact = [(i % 10,) for i in range(20)]
    one_miss = [(i % 10,) for i in range(19)] + [(99,)]
    two_same_misses = [(i % 9,) for i in range(18)] + [(99,), (99,)]
    with_null = [(i % 10,) for i in range(19)] + [(None,)]
    none = [(1000 + i % 5,) for i in range(20)]
    return {
        "pk": metadata_frame(spark, keys, "k int"),
        "fk_exact": metadata_frame(spark, exact, "f int"),
        "fk_one_miss": metadata_frame(spark, one_miss, "f int"),
        "fk_dups": metadata_frame(spark, two_same_misses, "f int"),
        "fk_null": metadata_frame(spark, with_null, "f int"),
        "fk_none": metadata_frame(spark, none, "f int"),
    }


@pytest.mark.parametrize(("few", "staged"), [(100, False), (4, True)])
def test_many_cells_of_few_values_are_counted_at_once(spark, links, monkeypatch, few, staged):
    rows = [(i % 5, i % 6 if i % 50 else 99) for i in range(60)]
    tables = {
        "pk": metadata_frame(spark, [(i,) for i in range(60)], "k int"),
        "fk": metadata_frame(spark, rows, "f int, g int"),
    }
    params = Params.ungated(sup_out_foreign_key=0.05)
    expected = links(tables, params, strategy="oneshot")
    assert expected == {("fk.f", "pk.k"): 0.0, ("fk.g", "pk.k"): 2 / 60}
    refuted, plain = [], discover._Run.refute_pairs
    monkeypatch.setattr(discover._Run, "refute_pairs", lambda run: refuted.append(plain(run)))
    monkeypatch.setattr(discover, "STAGED_FROM_CELLS", 1)
    monkeypatch.setattr(discover, "FEW_VALUES", few)
    assert links(tables, params) == expected
    assert bool(refuted) == staged


@pytest.mark.parametrize("strategy", BOTH)
@pytest.mark.parametrize(
    ("sup", "base", "expected"),
    [
        (0.0, "rows", {"fk_exact": 0.0}),
        (0.05, "rows", {"fk_exact": 0.0, "fk_one_miss": 0.05, "fk_null": 0.05}),
        (0.1, "rows",
         {"fk_exact": 0.0, "fk_one_miss": 0.05, "fk_null": 0.05, "fk_dups": 0.1}),
        (1.0, "rows",
         {"fk_exact": 0.0, "fk_one_miss": 0.05, "fk_null": 0.05, "fk_dups": 0.1,
          "fk_none": 1.0}),
        (0.0, "fixed", {"fk_exact": 0.0}),
        (0.0001, "fixed", {"fk_exact": 0.0, "fk_one_miss": 0.0001, "fk_null": 0.0001}),
        (0.05, "fixed",
         {"fk_exact": 0.0, "fk_one_miss": 0.0001, "fk_null": 0.0001, "fk_dups": 0.0002,
          "fk_none": 0.002}),
    ],
)
def test_tolerance_and_base(tables, links, strategy, sup, base, expected):
    params = Params.ungated(sup_out_foreign_key=sup, ratio_base=base)
    found = links(tables, params, strategy=strategy)
    assert {k[0].split(".")[0]: v for k, v in found.items() if k[1] == "pk.k"} == expected


def test_no_relation_inside_one_table(spark, links):
    frame = spark.range(10).selectExpr("id", "id % 3 AS parent")
    assert links({"self": frame}) == {}


def test_empty_source_and_unknown_tables(spark, links):
    assert links({}) == {}
    assert links({"a": spark.range(5)}, Params.ungated(tables=("nowhere",))) == {}
    assert links({"a": spark.range(5), "b": spark.range(0)}) == {}


def test_columns_that_cannot_hold_keys(spark, links):
    frame = spark.range(5).selectExpr(
        "id", "array(id) AS a", "map(id, id) AS m", "struct(id) AS s", "CAST('x' AS BINARY) AS b"
    )
    assert set(links({"t": frame, "u": spark.range(9).withColumnRenamed("id", "k")})) == {
        ("t.id", "u.k")
    }


@pytest.mark.parametrize("strategy", BOTH)
def test_role_bars(spark, links, strategy):
    tables = {"a": spark.range(5), "b": spark.range(5), "c": spark.range(3)}
    params = Params.ungated(not_base_tables=("a",), not_cite_tables=("c",))
    assert set(links(tables, params, strategy=strategy)) == {("a.id", "b.id")}


def test_gates_and_rules_apply(spark, links):
    key = spark.range(100).withColumnRenamed("id", "k")
    refs = spark.range(100).selectExpr(
        "id % 30 AS kept", "id % 29 AS repeated", "id % 30 AS EXT_ruled_out"
    )
    short = spark.range(4).withColumnRenamed("id", "few")
    found = links({"k": key, "r": refs, "s": short}, Params())
    assert set(found) == {("r.kept", "k.k")}


def test_max_rows(spark, links):
    tables = {"long": spark.range(100), "a": spark.range(10), "b": spark.range(5)}
    found = links(tables, Params.ungated(max_rows=10))
    assert set(found) == {("b.id", "a.id")}


def test_one_value_in_a_third_of_all_rows(spark, links):
    hot = spark.range(30_000).selectExpr(
        "IF(id % 3 = 0, 7, id % 1000) AS f", "IF(id % 3 = 0, NULL, id % 1000) AS n",
        "IF(id % 3 = 0, -1, id % 1000) AS m",
    )
    tables = {"k": spark.range(1_000), "hot": hot}
    for strategy in BOTH:
        found = links(tables, Params.ungated(sup_out_foreign_key=0.4), strategy=strategy)
        assert found == {
            ("hot.f", "k.id"): 0.0,
            ("hot.n", "k.id"): 10_000 / 30_000,
            ("hot.m", "k.id"): 10_000 / 30_000,
        }


@pytest.mark.parametrize("policy", ["any", "unique_only", "ascii"])
@pytest.mark.parametrize("sample", [None, 40])
def test_strategies_agree(spark, links, policy, sample):
    rng = random.Random(5)
    tables = {}
    for name in "abcd":
        rows = [
            (i, rng.randint(0, 60), f"t{rng.randint(0, 40)}", f"é{i}",
             None if rng.random() < 0.1 else rng.randint(0, 20))
            for i in range(rng.randint(20, 80))
        ]
        tables[name] = metadata_frame(
            spark, rows, f"{name}1 int, {name}2 int, {name}3 string, {name}4 string, {name}5 int"
        )
    bars = {"not_base_tables": ("b",), "not_cite_tables": ("c",)}
    for changes in (bars, {**bars, "both_roles": False, "sup_out_foreign_key": 0.2}):
        params = Params.ungated(class_policy=policy, sample_rows=sample, **changes)
        oneshot = links(tables, params, strategy="oneshot")
        assert oneshot == links(tables, params, strategy="staged")
        assert oneshot or not params.both_roles


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.lists(st.one_of(st.none(), st.integers(0, 6)), min_size=1, max_size=8),
        min_size=2, max_size=5,
    ),
    st.sampled_from([0.0, 0.25, 0.5]),
)
def test_against_brute_force(spark, links, columns, sup):
    """All relations, recomputed value by value in plain Python."""
    tables = {
        f"t{i}": metadata_frame(spark, [(v,) for v in cells], f"c{i} int")
        for i, cells in enumerate(columns)
    }
    expected = {}
    for p, keys in enumerate(columns):
        if None in keys or len(set(keys)) < len(keys):
            continue
        for f, cells in enumerate(columns):
            misses = sum(cell not in set(keys) for cell in cells)
            if f != p and misses / len(cells) <= sup:
                expected[f"t{f}.c{f}", f"t{p}.c{p}"] = misses / len(cells)
    params = Params.ungated(sup_out_foreign_key=sup)
    assert links(tables, params, strategy="oneshot") == expected
    assert links(tables, params, strategy="staged") == expected


def test_one_shuffle_result_equals_single_pair_probe(spark, links):
    keys = spark.range(0, 1000, 3).withColumnRenamed("id", "k")
    refs = spark.range(500).selectExpr("id * 2 AS f")
    missing = orphan_rows(refs, "f", keys, "k").count()
    texts = refs.selectExpr("CAST(f AS STRING) AS f")
    assert orphan_rows(texts, "f", keys, "k").count() == missing
    assert matched_rows(texts, "f", keys, "k").count() == 500 - missing
    found = links({"k": keys, "r": refs}, Params.ungated(sup_out_foreign_key=0.9))
    assert found["r.f", "k.k"] == missing / 500


def test_wrong_options(spark):
    from keylink import discover

    with pytest.raises(ValueError):
        Params(class_policy="none")
    with pytest.raises(ValueError):
        Params(sample_rows=0)
    with pytest.raises(ValueError):
        discover(spark, Source("db", {}), strategy="other")
