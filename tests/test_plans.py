"""What the physical plans must and must not contain."""

import re

import pytest

from checks.queries import QUERIES, source
from keylink import Params, discover
from keylink.operators import inclusion, values
from keylink.sources.catalog import table_row_counts
from keylink.sources.workspace import Workspace

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def plan_of(capsys):
    def explain(frame):
        capsys.readouterr()
        frame.explain("formatted")
        return capsys.readouterr().out

    return explain


@pytest.fixture(scope="module")
def src(spark):
    return source(spark, SF_DIR)


@pytest.mark.parametrize("strategy", ["oneshot", "staged"])
@pytest.mark.parametrize("options", [{}, {"sample_rows": 100}])
def test_discovery_enumerates_no_pairs(spark, src, plan_of, strategy, options):
    plan = plan_of(discover(spark, src, Params.ungated(**options), strategy=strategy))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan


def test_counting_reads_each_column_once_and_combines_before_the_shuffle(src, plan_of):
    plan = plan_of(values.value_counts(src, values.key_columns(src)))
    read = re.findall(r"(\w+):\w+", " ".join(re.findall(r"ReadSchema: struct<(.*)>", plan)))
    assert len(read) == len(values.key_columns(src))
    assert plan.count("Functions [1]: [partial_count(1)]") == plan.count("Arguments: hashpart")


def test_one_shuffle_by_value(spark, src, plan_of):
    counts = Workspace(spark).save(values.value_counts(src, values.key_columns(src)), "c")
    plan = plan_of(inclusion.hits_by_pair(inclusion.shared_rows(counts, [0, 3], [0, 2])))
    assert len(re.findall(r"hashpartitioning\(v#", plan)) == 1
    assert re.search(r"PushedFilters: \[.*In\(cid.*IsNotNull\(v\)", plan)


def test_row_counts_read_no_column(src, plan_of):
    plan = plan_of(table_row_counts(src))
    assert set(re.findall(r"ReadSchema: (.*)", plan)) == {"struct<>"}


def test_pair_probe_reads_two_columns_in_their_own_type(spark, plan_of):
    plan = plan_of(QUERIES["orphan_rows"](spark, SF_DIR))
    assert "struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    assert "struct<s_suppkey:bigint>" in plan
    assert "cast" not in plan.lower().replace("broadcast", "")
