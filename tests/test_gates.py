import pytest

from keylink import Source
from keylink.operators import gates
from keylink.operators.profile import column_profile
from keylink.operators.values import key_columns, value_counts


def reasons(frame):
    return {r["table_name"]: r["reason"] for r in frame.collect()}


def test_table_gate_bounds(table):
    counts = table(
        "table_name string, row_count bigint",
        [("none", 0), ("below", 4), ("least", 5), ("most", 20), ("above", 21), ("gone", None)],
    )
    assert reasons(gates.table_gate(counts, inf_tab_len=5, max_rows=20)) == {
        "none": "empty", "below": "too_short", "least": "ok", "most": "ok",
        "above": "too_long", "gone": "unreadable",
    }
    assert reasons(gates.table_gate(counts, inf_tab_len=5))["above"] == "ok"


NAMES = ["EXT_a", "ext_b", "id", "idx", "code"]


def kept_names(spark, table, rules, mode):
    columns = table("table_name string, column_name string", [("t", n) for n in NAMES])
    gated = gates.column_name_gate(spark, columns, rules, mode)
    return {r["column_name"] for r in gated.filter("name_kept").collect()}


@pytest.mark.parametrize(
    ("rules", "mode", "kept"),
    [
        ({}, "documented", set(NAMES)),
        ({}, "compat", set(NAMES)),
        ({"_": ["EXT_", "ext_"]}, "documented", {"id", "idx", "code"}),
        ({"_": ["EXT_", "ext_"]}, "compat", {"ext_b", "id", "idx", "code"}),
        ({"_": ["id%"]}, "documented", {"EXT_a", "ext_b", "idx", "code"}),
        ({"_": ["id%"]}, "compat", {"id"}),
        ({"_": []}, "documented", set(NAMES)),
        ({"_": []}, "compat", set()),
        ({"_": ["EXT_", "ext_"], "t": ["id%", "co"]}, "documented", {"idx"}),
        ({"_": ["EXT_", "ext_"], "t": ["id%", "co"]}, "compat", {"ext_b", "idx"}),
        ({"t": ["id"]}, "documented", {"EXT_a", "ext_b", "code"}),
        ({"_": [], "other": ["id"]}, "documented", set(NAMES)),
    ],
)
def test_name_rules(spark, table, rules, mode, kept):
    assert kept_names(spark, table, rules, mode) == kept


def test_type_policies(table):
    columns = table(
        "column_name string, type_name string, type_class string",
        [("a", "varchar", "text"), ("b", "INT", "integral"), ("c", "BIGINT", "integral"),
         ("d", "ARRAY", "other"), ("e", "NVARCHAR2", "text")],
    )

    def kept(policy):
        gated = gates.column_type_gate(columns, policy).filter("type_kept")
        return {r["column_name"] for r in gated.collect()}

    assert kept("mysql") == {"a", "b"}
    assert kept("oracle") == {"a", "e"}
    assert kept("all") == {"a", "b", "c", "e"}


def gate_of(table, cells, **gate):
    source = Source("db", {"t": table("v string", [(cell,) for cell in cells])})
    profile = column_profile(value_counts(source, key_columns(source), text_stats=True))
    return gates.value_gate(profile, **gate).first()["reject_reason"]


@pytest.mark.parametrize(
    ("cells", "reason"),
    [
        (["a", "b"] * 5, "distinct_ratio"),
        (["a", "b", "c"] + ["a"] * 7, None),
        (["a", "b", "c", "d"] + ["a"] * 6, None),
        (["a", "b", None] + ["a"] * 7, None),  # NULL is one of three values
    ],
)
def test_distinct_ratio(table, cells, reason):
    assert gate_of(table, cells, inf_dup_ratio=0.3) == reason


@pytest.mark.parametrize(
    ("blanks", "reason"), [([None] * 4 + [""] * 4, None), ([None] * 5 + [""] * 4, "blank_ratio")]
)
def test_blank_ratio(table, blanks, reason):
    cells = blanks + ["x"] * (10 - len(blanks))
    assert gate_of(table, cells) == reason


@pytest.mark.parametrize(
    ("cells", "reason"),
    [
        (["aa", "aaa", "aa", "aaa"], "avg_len"),
        (["aaa", "bbb", "aa", "aaaa"], None),
        (["aaaa", "b", None, "ccc"], None),  # NULL counts as four characters
    ],
)
def test_average_length(table, cells, reason):
    assert gate_of(table, cells, use_str_len=True, inf_str_len=3) == reason
    assert gate_of(table, cells, use_str_len=False, inf_str_len=3) is None


def test_first_failing_gate_is_named(table):
    cells = [""] * 10
    assert gate_of(table, cells, use_str_len=True, inf_str_len=1, inf_dup_ratio=0.3) == "avg_len"
    assert gate_of(table, cells, inf_dup_ratio=0.3) == "distinct_ratio"
    assert gate_of(table, cells, inf_dup_ratio=0.1) == "blank_ratio"
