"""Many models at once, and relations over many runs."""

import random
from dataclasses import replace
from datetime import datetime

from keylink import Params, Source, Workspace, discover, discover_many
from keylink.functions.frames import metadata_frame
from keylink.operators import history
from keylink.operators.results import KEY_IN_MODEL
from keylink.plans import discover as plan
from keylink.plans.lifecycle import run_model
from keylink.sources.store import ResultStore


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_many_models_equal_each_alone_and_count_once(spark, monkeypatch):
    rng = random.Random(3)
    tables = {
        name: metadata_frame(
            spark,
            [(i, rng.randint(0, 60), f"t{rng.randint(0, 30)}", None if i % 9 == 0 else i) for i in range(n)],
            f"{name}1 int, {name}2 int, {name}3 string, {name}4 int",
        )
        for name, n in (("a", 80), ("b", 40), ("c", 65), ("d", 3))
    }
    source = Source("db", tables)
    models = [
        Params.ungated(model_id="plain"),
        Params(model_id="gated"),
        Params.ungated(model_id="loose", sup_out_foreign_key=0.4),
        Params.ungated(model_id="unique", class_policy="unique_only"),
        Params.ungated(model_id="ascii", class_policy="ascii", use_str_len=True, inf_str_len=2),
        Params.ungated(model_id="few", tables=("a", "c", "nowhere"), not_base_tables=("a",)),
        Params.ungated(model_id="sampled", sample_rows=20, sup_out_foreign_key=0.5),
    ]
    expected = sorted((r for p in models for r in rows(discover(spark, source, p))), key=str)
    counted = []
    plain = plan.value_counts

    def spy(src, columns, *args, **options):
        counted.append(sorted(c.cid for c in columns))
        return plain(src, columns, *args, **options)

    monkeypatch.setattr(plan, "value_counts", spy)
    assert rows(discover_many(spark, source, models[:-1])) == [r for r in expected if r[0] != "sampled"]
    assert counted == [list(range(16))]
    assert rows(discover_many(spark, source, models)) == expected
    assert {r[0] for r in expected} >= {"plain", "gated", "loose", "few", "sampled"}
    assert rows(discover_many(spark, Source("db", {}), models[:2])) == []
    hitless = [replace(p, sup_out_foreign_key=1.0) for p in models[:2]]
    alone = sorted((r for p in hitless for r in rows(discover(spark, source, p))), key=str)
    assert rows(discover_many(spark, source, hitless)) == alone


def found(spark, runs):
    """Relations named by one letter: {run: letters}."""
    cells = [("m", "db", "t", c, "db", "u", "f", run) for run, letters in runs.items() for c in letters]
    return metadata_frame(spark, cells, ", ".join(f"{c} string" for c in KEY_IN_MODEL) + ", run int")


def intervals(frame):
    return {(r["column1"], r["valid_from"], r["valid_to"]) for r in frame.collect()}


def test_intervals_of_relations(spark):
    runs = {3: "abc", 4: "ab", 7: "bcd", 9: "", 12: "acd"}
    whole = history.relation_history(found(spark, runs), list(runs))
    assert intervals(whole) == {
        ("a", 3, 7), ("a", 12, None), ("b", 3, 9), ("c", 3, 4), ("c", 7, 9), ("c", 12, None),
        ("d", 7, 9), ("d", 12, None),
    }
    assert {(r["column1"], r["intervals"]) for r in history.returned(whole).collect()} == {
        ("a", 2), ("c", 3), ("d", 2),
    }
    for run, letters in runs.items():
        assert {r["column1"] for r in history.as_of(whole, run).collect()} == set(letters)
    # run by run, as each becomes known
    space = Workspace(spark)
    grown = history.relation_history(found(spark, {3: "abc"}), [3])
    for run in list(runs)[1:]:
        grown = space.save(history.extend_history(grown, found(spark, {run: runs[run]}), run), "history")
    assert intervals(grown) == intervals(whole)
    assert grown.columns == list(history.HISTORY_COLUMNS)


def test_history_of_stored_runs(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    params = Params.ungated(model_id="m")
    key = spark.range(10).withColumnRenamed("id", "k")
    f, g = (spark.range(20).selectExpr(f"id % 5 AS {c}") for c in "xy")
    for tables in ({"k": key, "f": f}, {"k": key, "g": g}, {"k": key, "f": f, "g": g}):
        run_model(spark, Source("db", tables), store, params, now=datetime(2024, 1, 1))
    got = {(r["table2"], r["valid_from"], r["valid_to"]) for r in store.history("m").collect()}
    assert got == {("f", 1, 2), ("f", 3, None), ("g", 2, None)}
    assert store.history("other").collect() == []
    assert store.committed_runs("m") == [1, 2, 3]
