from datetime import datetime

import pytest

from keylink import Params, Source
from keylink.functions.frames import metadata_frame
from keylink.operators import results
from keylink.plans.lifecycle import run_model
from keylink.sources.store import DONE, FAILED, KeyStore, ResultStore, latest_status
from keylink.operators.values import key_columns

SCHEMA = (
    "id string, model string, db1 string, table1 string, column1 string, db2 string, "
    "table2 string, column2 string, status int, scantype int"
)


def rel(table1, column1, table2="f", column2="x", model="m", status=1, scantype=0):
    return ("i", model, "d", table1, column1, "d", table2, column2, status, scantype)


def keys(frame):
    return sorted(
        (r["model"], r["table1"], r["column1"], r["status"], r["scantype"])
        for r in frame.collect()
    )


def test_status_compares_columns_not_their_concatenation(table):
    current = table(SCHEMA, [rel("ab", "c"), rel("a", "bc"), rel("new", "k")])
    previous = table(SCHEMA, [rel("a", "bc"), rel("a", "bc", scantype=1), rel("gone", "k"),
                              rel("new", "k", model="other")])
    assert keys(results.relation_status(current, previous)) == [
        ("m", "a", "bc", 0, 0), ("m", "ab", "c", 1, 0), ("m", "new", "k", 1, 0),
    ]
    assert [k[1] for k in keys(results.new_relations(current, previous))] == ["ab", "new"]
    removed = results.removed_relations(previous, current).filter("model = 'm'")
    assert [k[1] for k in keys(removed)] == ["gone"]


def test_replace_keeps_user_rows_without_doubling_them(table):
    stored = table(SCHEMA, [rel("a", "k"), rel("b", "k", scantype=1), rel("z", "k", model="o"),
                            rel("gone", "k"), rel("gone2", "k", scantype=1)])
    current = table(SCHEMA, [rel("a", "k", status=0), rel("b", "k", status=0), rel("c", "k")])
    models = table("model string", [("m",)])
    assert keys(results.replace_relations(stored, current, models)) == [
        ("m", "a", "k", 0, 0), ("m", "b", "k", 1, 1), ("m", "c", "k", 1, 0),
        ("m", "gone2", "k", 1, 1), ("o", "z", "k", 1, 0),
    ]


def test_summary(table):
    rows = [rel("a", "k"), rel("b", "k", status=0), rel("c", "k", model="o", status=0)]
    got = {r["model"]: (r["relation_num"], r["new_relation_num"])
           for r in results.run_summary(table(SCHEMA, rows)).collect()}
    assert got == {"m": (2, 1), "o": (1, 0)}


def test_latest_status(table):
    log = table(
        "id string, run int, analysis_status string",
        [("m", 1, "1"), ("m", 1, "2"), ("m", 2, "1"), ("o", 1, "failed"), ("o", 1, "1")],
    )
    got = {r["id"]: (r["run"], r["analysis_status"]) for r in latest_status(log).collect()}
    assert got == {"m": (2, "1"), "o": (1, "failed")}


NOW = datetime(2024, 1, 1)


def test_runs_of_one_model(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    params = Params.ungated(model_id="m")
    key = spark.range(10).withColumnRenamed("id", "k")
    first = Source("db", {"k": key, "f": spark.range(20).selectExpr("id % 5 AS x")})
    run_model(spark, first, store, params, "alg", "obj", NOW)
    status = store.statuses().first()
    assert (status["analysis_status"], status["relation_num"], status["new_relation_num"]) == (
        DONE, 1, 1)
    assert (status["algorithm_name"], status["execute_obj"]) == ("alg", "obj")

    # The user edits that relation; the next run finds another one as well.
    edited = store.previous("m").collect()[0].asDict()
    edited.update(scantype=1, matching_degree=0.5)
    from keylink.sources.store import RESULTS_SCHEMA
    stored = metadata_frame(spark, [tuple(edited.values())], RESULTS_SCHEMA.replace(", run int", ""))
    store.write_results(stored, 2)
    store.append_status("m", 2, DONE)
    assert store.commit("m", 2, store.version("m")[0])
    second = Source("db", {**first.tables, "g": spark.range(20).selectExpr("id % 7 AS y")})
    run_model(spark, second, store, params, now=NOW)
    rows = {(r["table2"], r["scantype"], r["status"]) for r in store.previous("m").collect()}
    assert rows == {("f", 1, 1), ("g", 0, 1)}
    assert store.last_run("m") == 3

    # A run that finds nothing closes its status and clears the automatic rows.
    run_model(spark, Source("db", {"k": key}), store, params, now=NOW)
    assert {r["table2"] for r in store.previous("m").collect()} == {"f"}
    assert store.statuses().first()["relation_num"] == 0


def test_failed_run_changes_nothing(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    params = Params.ungated(model_id="m")
    good = Source("db", {"k": spark.range(10), "f": spark.range(4)})
    run_model(spark, good, store, params, now=NOW)
    before = store.previous("m").count()
    broken = Source("db", {"k": spark.range(10).selectExpr("CAST(raise_error('x') AS BIGINT) AS k")})
    with pytest.raises(Exception, match="x"):
        run_model(spark, broken, store, params, now=NOW)
    assert store.statuses().first()["analysis_status"] == FAILED
    assert store.previous("m").count() == before == 1


def test_key_values_are_reused_until_the_column_changes(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "keys"))
    source = Source("db", {"k": spark.range(10), "h": spark.range(5).withColumnRenamed("id", "q")})
    columns = key_columns(source)
    assert len(store.materialize(source, columns)) == 2
    assert store.materialize(source, columns) == []
    # Same number of rows and of distinct values, but one value differs.
    changed = Source("db", {"k": spark.range(1, 11), "h": source.tables["h"]})
    assert [c.table for c in store.materialize(changed, columns)] == ["k"]
    got = store.values(changed, columns).groupBy("pk_table").agg({"v": "max"}).collect()
    assert {r[0]: r[1] for r in got} == {"k": "9", "h": "4"}
    assert store.values(changed, columns).filter("pk_table = 'k' AND v = '10'").count() == 1


def test_two_runs_at_the_same_time(spark, tmp_path, monkeypatch):
    """The second run commits while the first is still at work; both stay whole."""
    from keylink.plans import lifecycle

    store = ResultStore(spark, str(tmp_path / "store"))
    params = Params.ungated(model_id="m")
    key = spark.range(10).withColumnRenamed("id", "k")
    first = Source("db", {"k": key, "f": spark.range(20).selectExpr("id % 5 AS x")})
    second = Source("db", {"k": key, "g": spark.range(20).selectExpr("id % 7 AS y")})
    plain, inside = lifecycle.replace_relations, []

    def once(*args):
        monkeypatch.setattr(lifecycle, "replace_relations", plain)
        inside.append(run_model(spark, second, store, params, now=NOW).count())
        return plain(*args)

    monkeypatch.setattr(lifecycle, "replace_relations", once)
    run_model(spark, first, store, params, now=NOW)
    assert inside == [1]
    assert store.version("m") == (2, 3)
    log = {(r["run"], r["analysis_status"]) for r in store.status_log().collect()}
    assert {(2, DONE), (1, FAILED), (3, DONE)} <= log
    # each version holds the relations of one run, none of both
    assert {r["table2"] for r in store.previous("m", 2).collect()} == {"g"}
    assert {r["table2"] for r in store.previous("m").collect()} == {"f"}
    status = store.statuses().first()
    assert (status["run"], status["relation_num"], status["new_relation_num"]) == (3, 1, 1)


def test_claims_and_commits_are_exclusive(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    stores = [ResultStore(spark, str(tmp_path / "store")) for _ in range(6)]
    with ThreadPoolExecutor(max_workers=6) as pool:
        numbers = list(pool.map(lambda s: s.claim_run("a/b ü"), stores))
        assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
        won = list(pool.map(lambda s: s.commit("a/b ü", 1 + stores.index(s), 0), stores))
    assert won.count(True) == 1
    version, run = stores[0].version("a/b ü")
    assert version == 1 and won[run - 1] and stores[0].version("other") == (0, 0)
