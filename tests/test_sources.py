import json

import pytest

from keylink import Params, files_source, spark_catalog_source
from keylink.__main__ import main
from keylink.operators.gates import table_gate
from keylink.params import resolve_params
from keylink.sources import catalog
from keylink.sources.jdbc import DIALECTS, Connection, dialect_of, policies, split_options
from keylink.sources.store import ResultStore
from keylink.sources.workspace import CLEANUP, Workspace, shared_folder
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

CONFIG = (
    "model string, csl string, ds string, idr double, isl int, itl int, tables1 string, "
    "tables2 string"
)


def resolved(table, rows, model="m"):
    config = table(CONFIG, rows)
    key = F.concat("model", "model")
    return Params.from_row(resolve_params(table("model string", [(model,)]), config, key).first())


def test_params_without_a_row(table):
    p = resolved(table, [("other", "1", None, 0.9, 9, 9, "a", None)])
    assert (p.inf_dup_ratio, p.inf_str_len, p.inf_tab_len) == (0.3, 1, 5)
    assert p.name_rules == {"_": ["EXT_", "ext_"]} and not p.use_str_len and p.tables == ()


def test_params_of_an_all_null_row(table):
    p = resolved(table, [("mm", None, None, None, None, None, None, None)])
    assert (p.inf_dup_ratio, p.inf_str_len, p.inf_tab_len) == (0.4, 3, 10)
    assert p.name_rules == {"_": ["EXT_", "ext_"]} and p.tables == ()


def test_params_of_a_full_row(table):
    rules = {"_": ["x_"], "t": ["y%"]}
    p = resolved(table, [("mm", "1", json.dumps(rules), 0.0, 0, 0, "a,b", "unused")])
    assert (p.inf_dup_ratio, p.inf_str_len, p.inf_tab_len) == (0.0, 0, 0)
    assert p.name_rules == rules and p.use_str_len and p.tables == ("a", "b")


def test_unreadable_rules_fall_back_to_the_no_row_defaults(table):
    p = resolved(table, [("mm", "1", "[1, 2", 0.9, 9, 9, "a", None)])
    assert (p.inf_dup_ratio, p.use_str_len, p.tables) == (0.3, False, ())


def test_ddl_comments(table):
    ddl = table("t string, ddl string", [
        ("a", "CREATE TABLE a (\n x int\n)\nCOMMENT 'of a'\nROW FORMAT"),
        ("b", "CREATE TABLE b (\n x int COMMENT 'col'\n)\nROW FORMAT"),
        ("c", None),
    ])
    got = {r["t"]: r["table_comment"] for r in catalog.comment_from_ddl(ddl).collect()}
    assert got == {"a": "'of a'", "b": "", "c": ""}


def test_file_tables_are_listed_and_read(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "a.parquet"))
    spark.range(7).write.parquet(str(tmp_path / "b.parquet"))
    assert catalog.list_file_tables(spark, str(tmp_path)) == ["a", "b"]
    source = files_source(spark, str(tmp_path))
    counts = {r["table_name"]: r["row_count"] for r in catalog.table_row_counts(source).collect()}
    assert counts == {"a": 5, "b": 7}
    assert source.unknown(["a", "zz"]) == ["zz"]


def test_tables_that_cannot_be_opened_are_reported(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "a.parquet"))
    source = files_source(spark, str(tmp_path), ["a", "gone"])
    assert list(source.tables) == ["a"] and source.unreadable == ("gone",)
    gated = table_gate(catalog.table_row_counts(source))
    assert {(r["table_name"], r["row_count"], r["reason"]) for r in gated.collect()} == {
        ("a", 5, "ok"), ("gone", None, "unreadable"),
    }


@pytest.mark.parametrize("fmt", ["csv", "json", "orc"])
def test_other_file_formats(spark, tmp_path, fmt):
    options = {"header": "true", "inferSchema": "true"} if fmt == "csv" else {}
    spark.range(5).write.format(fmt).options(**options).save(str(tmp_path / f"a.{fmt}"))
    source = files_source(spark, str(tmp_path), ["a"], fmt, options=options)
    assert [(c.name, c.type_name in ("BIGINT", "INT")) for c in source.columns()] == [("id", True)]


def test_session_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.sql("CREATE TABLE shop.item (id INT COMMENT 'item id', n STRING) USING parquet "
              "COMMENT 'items sold'")
    spark.sql("INSERT INTO shop.item VALUES (1, 'a')")
    spark.sql("CREATE VIEW shop.seen AS SELECT * FROM shop.item")
    source = spark_catalog_source(spark, "shop")
    assert list(source.tables) == ["item"]
    assert source.table_comments["item"] == "items sold"
    assert [c.comment for c in source.columns()] == ["item id", ""]
    spark.sql("DROP DATABASE shop CASCADE")


def test_column_counts_with_empty_tables(spark):
    source = catalog.Source("db", {"e": spark.range(0), "f": spark.range(3)})
    assert {tuple(r) for r in catalog.column_counts(source).collect()} == {(0, 0, 0), (1, 3, 3)}
    got = {r["table_name"]: r["row_count"] for r in catalog.table_row_counts(source).collect()}
    assert got == {"e": 0, "f": 3}


def test_jdbc_addresses_and_policies():
    c = Connection("mysql", "shop", "h", 3306, "u", "p")
    assert c.options()["url"] == "jdbc:mysql://h:3306/shop?useCursorFetch=true"
    assert c.table_name("a`b") == "`shop`.`a``b`"
    assert "table_schema = 'shop'" in c.metadata_query("columns")
    oracle = Connection("Oracle", "O'S", url="jdbc:oracle:thin:@h:1521/x")
    assert oracle.options()["url"] == "jdbc:oracle:thin:@h:1521/x"
    assert "owner = 'O''S'" in oracle.metadata_query("tables")
    assert Connection("sqlserver", "d").table_name("t") == "[dbo].[t]"
    assert Connection("postgresql", "d").table_name("t") == '"public"."t"'
    assert policies("MySQL") == ("mysql", "unique_only")
    assert policies("oracle") == ("oracle", "unique_only")
    assert policies("sqlserver") == ("mysql", "any")
    assert policies("hive") == policies("postgresql") == ("all", "ascii")
    assert dialect_of("gbase").max_connections == 1
    assert len(DIALECTS) == 5
    with pytest.raises(ValueError, match="unsupported"):
        dialect_of("dbase")


def test_jdbc_split_needs_an_integer_column(spark):
    assert split_options(spark.range(1), 4) == {"partitionColumn": "id", "numPartitions": "4"}
    assert split_options(spark.range(1), 1) == {}
    assert split_options(spark.range(1).selectExpr("'a' AS a"), 4) == {}


def test_workspace_uses_the_named_folder(spark, tmp_path):
    space = Workspace(spark)
    assert space.root.startswith(spark.conf.get("spark.checkpoint.dir"))
    saved = space.save(spark.range(3), "x")
    assert saved.count() == 3 and saved.inputFiles()


class Session:
    """Stands in for a session with given settings."""

    def __init__(self, **settings):
        self.conf = self
        self.settings = settings

    def get(self, name, default):
        return self.settings.get(name.replace(".", "_"), default)


def test_scratch_folder_per_kind_of_session():
    named = Session(spark_checkpoint_dir="hdfs://c/scratch/", spark_master="yarn")
    assert shared_folder(named) == "hdfs://c/scratch"
    local = Session(spark_master="local[8]")
    assert shared_folder(local) == shared_folder(local)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(spark_master="yarn"))


def test_command_line(spark, tmp_path, capsys):
    for name, rows in (("k", 20), ("f", 10)):
        spark.range(rows).write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    config = tmp_path / "config.parquet"
    spark.createDataFrame([("mm", None, "{}", 0.1, 0, 0, "k,f,gone")],
                          CONFIG.replace(", tables2 string", "")).write.parquet(str(config))
    main(["--model-id", "m", "--store", str(tmp_path / "out"), "--path", str(tmp_path / "in"),
          "--config", str(config), "--config-key", "mm", "--algorithm-name", "links"])
    store = ResultStore(spark, str(tmp_path / "out"))
    assert {(r["table2"], r["table1"]) for r in store.previous("m").collect()} == {("f", "k")}
    assert store.statuses().first()["algorithm_name"] == "links"


def test_partitioned_folder_plain_folder_and_file_are_three_tables(spark, tmp_path):
    frame = spark.range(6).selectExpr("id", "id % 2 AS p")
    frame.write.partitionBy("p").parquet(f"{tmp_path}/orders.parquet")
    frame.write.parquet(f"{tmp_path}/plain.parquet")
    frame.coalesce(1).write.parquet(f"{tmp_path}/other")
    part = next((tmp_path / "other").glob("part-*.parquet"))
    (tmp_path / "single.parquet").write_bytes(part.read_bytes())
    assert catalog.list_file_tables(spark, str(tmp_path)) == ["orders", "plain", "single"]


def test_shuffles_of_a_scratch_table_go_when_it_is_written(spark, monkeypatch):
    """Only while tables are written: a result of the user's own may be asked for twice."""
    seen, write, before = [], DataFrameWriter.parquet, spark.conf.get(CLEANUP, None)

    def parquet(self, path):
        seen.append(spark.conf.get(CLEANUP, None))
        if len(seen) == 1:
            space.save(spark.range(3), "inner")
            seen.append(spark.conf.get(CLEANUP, None))
        write(self, path)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    space = Workspace(spark)
    assert space.save(spark.range(9).groupBy((F.col("id") % 2).alias("k")).count(), "outer").count() == 2
    assert seen == ["true"] * 3
    assert spark.conf.get(CLEANUP, None) == before
