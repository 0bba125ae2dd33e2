"""Value counts kept file by file."""

import pytest
from pyspark.sql import functions as F

from keylink import Params, Source, discover
from keylink.operators.profile import column_profile
from keylink.operators.values import key_columns, value_counts
from keylink.sources import counts as module
from keylink.sources.catalog import files_source
from keylink.sources.counts import CountStore, Refresh
from keylink.sources.workspace import Workspace


def rows(spark, first, end):
    return spark.range(first, end).selectExpr(
        "id", "id % 7 AS few", "IF(id % 5 = 0, NULL, concat('é', id)) AS text",
        "concat(repeat('long ', 20), id % 3) AS long", "CAST(id AS DOUBLE) / 4 AS real",
    )


@pytest.fixture
def shop(spark, tmp_path):
    """Puts files of table ``t`` and returns (put, remove, source)."""
    root = f"{tmp_path}/data"
    space = Workspace(spark)

    def put(name, first, end):
        rows(spark, first, end).coalesce(1).write.mode("overwrite").parquet(f"{root}/t.parquet/{name}")

    def source():
        return files_source(spark, root, ["t"], options={"recursiveFileLookup": "true"})

    return put, lambda name: space.remove(f"{root}/t.parquet/{name}"), source


def profile(frame):
    return {tuple(r) for r in column_profile(frame).collect()}


def expected(source):
    return profile(value_counts(source, key_columns(source), text_stats=True))


def test_only_new_files_are_counted(spark, shop, tmp_path, monkeypatch):
    put, remove, source = shop
    store = CountStore(spark, f"{tmp_path}/store")
    put("a", 0, 100)
    put("b", 50, 200)
    read = []
    plain = module.value_counts

    def spy(counted, columns, **options):
        frame = plain(counted, columns, **options)
        frame.collect()
        leaves = frame._jdf.queryExecution().executedPlan().executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        while any("QueryStage" in x.getClass().getSimpleName() for x in scans):
            found = []
            for x in scans:
                if "QueryStage" in x.getClass().getSimpleName():
                    below = x.plan().collectLeaves()
                    found += [below.apply(i) for i in range(below.size())]
                else:
                    found.append(x)
            scans = found
        read.append(sum(x.metrics().get("numFiles").get().value() for x in scans))
        return frame

    monkeypatch.setattr(module, "value_counts", spy)
    src = source()
    assert store.refresh(src, key_columns(src)) == [Refresh("t", 2, 0, 0)]
    assert profile(store.counts(src, key_columns(src))) == expected(src)
    put("c", 150, 260)
    src = source()
    assert store.refresh(src, key_columns(src)) == [Refresh("t", 1, 2, 0)]
    assert profile(store.counts(src, key_columns(src))) == expected(src)
    assert len(read) == 2 and read[1] > 0 and read[0] == 2 * read[1]
    assert store.refresh(src, key_columns(src)) == [Refresh("t", 0, 3, 0)] and len(read) == 2
    remove("a")
    put("b", 0, 10)
    src = source()
    assert store.refresh(src, key_columns(src)) == [Refresh("t", 1, 1, 2)]
    assert profile(store.counts(src, key_columns(src))) == expected(src)


def test_slots_and_other_columns(spark, shop, tmp_path):
    put, _, source = shop
    store = CountStore(spark, f"{tmp_path}/store")
    put("a", 0, 300)
    src = source()
    some = [c for c in key_columns(src) if c.name != "long"]
    store.refresh(src, some)
    assert store.refresh(src, key_columns(src))[0].added == 1  # counted again, with more columns
    whole = store.counts(src, key_columns(src)).select("cid", "v", "cnt", "slot").collect()
    part = store.counts(src, key_columns(src), (8, 20)).select("cid", "v", "cnt", "slot").collect()
    assert sorted(map(tuple, part), key=str) == sorted(
        (tuple(r) for r in whole if 8 <= r["slot"] < 20), key=str
    )
    assert len(whole) == value_counts(src, key_columns(src)).count()


def test_unfinished_and_doubled_loads_count_once(spark, shop, tmp_path):
    put, _, source = shop
    store, other = (CountStore(spark, f"{tmp_path}/store") for _ in range(2))
    put("a", 0, 50)
    src = source()
    columns = key_columns(src)
    stale = [tuple(r) for r in store._files(src, columns).select(*module._KEY).collect()]
    for each in (store, other):  # both found the file new
        each._load(src, columns, {"t": stale})
    assert profile(store.counts(src, columns)) == expected(src)
    lost = spark.read.parquet(f"{tmp_path}/store/counts").withColumn("load", F.lit("lost"))
    kept = f"{tmp_path}/store/counts"
    Workspace(spark).save(lost, "lost").write.mode("append").partitionBy("table_name", "load").parquet(kept)
    assert profile(store.counts(src, columns)) == expected(src)


@pytest.mark.parametrize("strategy", ["oneshot", "staged"])
def test_discovery_with_a_store(spark, tmp_path, strategy):
    root = f"{tmp_path}/data"
    spark.range(300).selectExpr("id AS k", "concat('n', id) AS name").write.parquet(f"{root}/keys.parquet")
    spark.range(500).selectExpr("id % 200 AS f", "id % 400 AS half", "concat('n', id % 9) AS name").write.parquet(
        f"{root}/refs.parquet"
    )
    files = files_source(spark, root)
    mixed = Source("db", {**files.tables, "local": spark.range(20).selectExpr("id AS l")})
    params = Params.ungated(sup_out_foreign_key=0.1)
    store = CountStore(spark, f"{tmp_path}/store")
    plain = sorted(map(tuple, discover(spark, mixed, params, strategy=strategy).collect()))
    for _ in range(2):
        kept = discover(spark, mixed, params, strategy=strategy, store=store).collect()
        assert sorted(map(tuple, kept)) == plain and plain
    columns = [c for c in key_columns(files)]
    assert [r.added for r in store.refresh(files, columns)] == [0, 0]


def test_other_tables_are_turned_away(spark, tmp_path):
    src = Source("db", {"local": spark.range(5).cache()})
    with pytest.raises(ValueError, match="local"):
        CountStore(spark, f"{tmp_path}/store").refresh(src, key_columns(src))
