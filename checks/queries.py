"""One query per operator, each over whole test tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.tables import COLUMN_COMMENTS, DB, OPTIONAL, TABLE_COMMENTS, TABLES
from keylink.functions.frames import metadata_frame, union_all
from keylink.operators import (
    candidates,
    gates,
    history,
    inclusion,
    results,
    rounds,
    sketches,
    values,
)
from keylink.operators.profile import column_profile, with_uniqueness
from keylink.params import Params, resolve_params
from keylink.plans.discover import discover, discover_many
from keylink.sources import catalog
from keylink.sources.catalog import Source, files_source
from keylink.sources.counts import CountStore
from keylink.sources.footers import counts_and_ranges
from keylink.sources.store import KeyStore
from keylink.sources.workspace import Workspace

MODEL = "m1"


# -- sources -------------------------------------------------------------------


def source(spark: SparkSession, sf_dir: str) -> Source:
    return files_source(
        spark, sf_dir, TABLES, db=DB, table_comments=TABLE_COMMENTS,
        column_comments=COLUMN_COMMENTS,
    )


def optional_source(spark: SparkSession, sf_dir: str) -> Source:
    base = source(spark, sf_dir).tables
    return Source(
        DB,
        {
            name: base[table].selectExpr(*[f"{sql} AS {col}" for col, (sql, _) in cols.items()])
            for name, (table, cols) in OPTIONAL.items()
        },
    )


def both_sources(spark: SparkSession, sf_dir: str) -> Source:
    base, extra = source(spark, sf_dir), optional_source(spark, sf_dir)
    return Source(DB, {**base.tables, **extra.tables}, TABLE_COMMENTS, COLUMN_COMMENTS)


def named(spark: SparkSession, src: Source, frame: DataFrame) -> DataFrame:
    """Puts table and column names to a frame that has ``cid``."""
    names = src.columns_frame(spark).select("cid", "table_name", "column_name")
    return frame.join(names, "cid").drop("cid")


def profiled(spark: SparkSession, src: Source, text_stats: bool = True) -> DataFrame:
    """Profile with names and types of every column that can hold keys."""
    cols = values.key_columns(src)
    meta = src.columns_frame(spark).select("cid", "table_name", "column_name", "is_text")
    return column_profile(values.value_counts(src, cols, text_stats)).join(meta, "cid")


# -- catalog -------------------------------------------------------------------


def catalog_tables(spark, sf_dir):
    src = source(spark, sf_dir)
    return src.tables_frame(spark).join(catalog.table_row_counts(src), "table_name")


def catalog_subset(spark, sf_dir):
    src = source(spark, sf_dir)
    wanted = ["orders", "lineitem", "labels", "no_such_table"]
    requested = metadata_frame(spark, [(name,) for name in wanted], "table_name string")
    listed = catalog.select_tables(src.tables_frame(spark), requested)
    return listed.join(catalog.table_row_counts(src.subset(wanted)), "table_name", "left")


def catalog_columns(spark, sf_dir):
    src = source(spark, sf_dir)
    counts = catalog.column_counts(src).select("cid", "non_null")
    return src.columns_frame(spark).join(counts, "cid").drop("cid")


def catalog_commented_columns(spark, sf_dir):
    src = source(spark, sf_dir)
    columns = src.columns_frame(spark).select("cid", "table_name", "column_name", "is_text")
    written = columns.join(catalog.column_counts(src), "cid").filter("is_text")
    comments = written.select(
        "table_name",
        "column_name",
        F.encode(F.concat(F.lit("texte écrit: "), F.col("non_null").cast("string")), "UTF-8")
        .alias("raw_comment"),
    )
    return catalog.attach_comments(columns.select("table_name", "column_name"), comments)


def ddl_comment(spark, sf_dir):
    statements = source(spark, sf_dir).tables["documents"].selectExpr(
        "doc_id",
        "concat('CREATE TABLE d', doc_id, ' (\\n id bigint\\n)', "
        "CASE WHEN lang = 'en' THEN '' ELSE concat(' COMMENT ', source, ' in ', lang) END, "
        "'\\nTBLPROPERTIES (', text, ')') AS ddl",
    )
    return catalog.comment_from_ddl(statements).select("doc_id", "table_comment")


CONFIG_COLUMNS = """
    concat(c_name, c_name) AS model,
    CASE WHEN c_mktsegment = 'BUILDING' THEN '1' WHEN c_nationkey < 9 THEN '0' END AS csl,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '{"_": ["x_", "y%"], "orders": ["o_"]}'
        WHEN 'MACHINERY' THEN 'no rules' WHEN 'FURNITURE' THEN '' END AS ds,
    CASE WHEN c_nationkey > 4 THEN c_nationkey / 100.0 END AS idr,
    CASE WHEN c_nationkey > 8 THEN c_nationkey END AS isl,
    CASE WHEN c_nationkey > 12 THEN c_nationkey END AS itl,
    CASE WHEN c_nationkey > 16 THEN concat('orders,', c_name) WHEN c_nationkey > 12 THEN '' END
        AS tables1
"""


def resolve_params_query(spark, sf_dir):
    customer = source(spark, sf_dir).tables["customer"]
    customer.createOrReplaceTempView("keylink_customer")
    config = spark.sql(f"SELECT {CONFIG_COLUMNS} FROM keylink_customer WHERE c_acctbal > 0")
    models = customer.select(F.col("c_name").alias("model"))
    resolved = resolve_params(models, config, F.concat("model", "model"))
    return resolved.select(
        "model", "configured", "use_str_len", "inf_dup_ratio", "inf_str_len", "inf_tab_len",
        F.array_join(F.col("name_rules")["_"], ",").alias("global_rules"),
        F.size("name_rules").cast("bigint").alias("rule_scopes"),
        F.array_join("tables", ",").alias("table_list"),
    )


# -- gates ---------------------------------------------------------------------

NAME_RULES = {"_": ["l_", "o_orderkey%", "text%"]}
TABLE_RULES = {"_": ["r_"], "orders": ["o_total", "o_custkey%"], "customer": ["c_"]}


def table_gate(spark, sf_dir):
    counts = catalog.table_row_counts(source(spark, sf_dir))
    return gates.table_gate(counts, inf_tab_len=30, max_rows=50_000)


def _kept_columns(spark, src, gated, flag):
    """Kept columns with their non-NULL rows; the others are never read."""
    kept = {row["cid"] for row in gated.filter(flag).select("cid").collect()}
    counts = catalog.column_counts(src, [c for c in src.columns() if c.cid in kept])
    return gated.join(counts.select("cid", "non_null"), "cid", "left").select(
        "table_name", "column_name", F.col(flag).alias("kept"), "non_null"
    )


def column_name_gate(spark, sf_dir):
    src = source(spark, sf_dir)
    gated = gates.column_name_gate(spark, src.columns_frame(spark), NAME_RULES)
    return _kept_columns(spark, src, gated, "name_kept")


def column_name_gate_by_table(spark, sf_dir):
    src = source(spark, sf_dir)
    gated = gates.column_name_gate(spark, src.columns_frame(spark), TABLE_RULES)
    return _kept_columns(spark, src, gated, "name_kept")


def column_name_gate_compat(spark, sf_dir):
    src = source(spark, sf_dir)
    gated = gates.column_name_gate(spark, src.columns_frame(spark), NAME_RULES, "compat")
    return _kept_columns(spark, src, gated, "name_kept")


def column_type_gate(spark, sf_dir):
    src = source(spark, sf_dir)
    gated = gates.column_type_gate(src.columns_frame(spark), "mysql")
    return _kept_columns(spark, src, gated, "type_kept")


def column_type_gate_oracle(spark, sf_dir):
    src = source(spark, sf_dir)
    gated = gates.column_type_gate(src.columns_frame(spark), "oracle")
    return _kept_columns(spark, src, gated, "type_kept")


def complete_columns(spark, sf_dir):
    src = both_sources(spark, sf_dir)
    return named(spark, src, gates.complete_columns(catalog.column_counts(src)))


def gate_avg_len(spark, sf_dir):
    profile = profiled(spark, both_sources(spark, sf_dir))
    return profile.select(
        "table_name", "column_name", "row_count", "len_sum",
        gates.too_short_text(6).alias("rejected"),
    )


def gate_distinct_ratio(spark, sf_dir):
    profile = profiled(spark, both_sources(spark, sf_dir), text_stats=False)
    return profile.select(
        "table_name", "column_name", "row_count", "groups",
        gates.too_few_distinct(0.3).alias("rejected"),
    )


def gate_blank_ratio(spark, sf_dir):
    profile = profiled(spark, both_sources(spark, sf_dir), text_stats=False)
    return profile.select(
        "table_name", "column_name", "row_count", "blanks",
        gates.too_blank().alias("rejected"),
    )


def value_gate(spark, sf_dir):
    profile = profiled(spark, both_sources(spark, sf_dir))
    gated = gates.value_gate(profile, True, 3, 0.001)
    return gated.select("table_name", "column_name", "reject_reason")


# -- profile -------------------------------------------------------------------


def table_row_counts(spark, sf_dir):
    return catalog.table_row_counts(both_sources(spark, sf_dir))


def column_non_null(spark, sf_dir):
    src = both_sources(spark, sf_dir)
    return named(spark, src, catalog.column_counts(src))


def column_distinct(spark, sf_dir):
    profile = profiled(spark, both_sources(spark, sf_dir), text_stats=False)
    return profile.select("table_name", "column_name", "distinct_values")


def column_ascii(spark, sf_dir):
    profile = profiled(spark, both_sources(spark, sf_dir)).filter("is_text")
    return profile.select("table_name", "column_name", "non_null", "ascii_rows")


def column_profile_query(spark, sf_dir):
    profile = with_uniqueness(profiled(spark, source(spark, sf_dir)))
    return profile.select(
        "table_name", "column_name", "row_count", "non_null", "distinct_values", "groups",
        "blanks", "ascii_rows", "is_unique",
    )


# -- values --------------------------------------------------------------------


def pk_values(spark, sf_dir):
    src = source(spark, sf_dir)
    unique = profiled(spark, src, text_stats=False).filter(candidates.is_pk())
    keys = {row["cid"] for row in unique.select("cid").collect()}
    return named(spark, src, values.pk_values(src, [c for c in src.columns() if c.cid in keys]))


def keys_kept(spark, sf_dir):
    """Key values out of the store, after a first call has put them there."""
    src, space = source(spark, sf_dir), Workspace(spark)
    unique = profiled(spark, src, text_stats=False).filter(candidates.is_pk())
    cids = {row["cid"] for row in unique.select("cid").collect()}
    keys = [c for c in src.columns() if c.cid in cids]
    store = KeyStore(spark, f"{space.root}/keys")
    store.materialize(src, keys)
    return store.values(src, keys)


def values_long(spark, sf_dir):
    src = both_sources(spark, sf_dir)
    cells = values.values_long(src, values.key_columns(src)).groupBy("cid").agg(
        F.count(F.lit(1)).alias("cells"), F.count("v").alias("present")
    )
    return named(spark, src, cells)


def column_sample(spark, sf_dir):
    lineitem = source(spark, sf_dir).tables["lineitem"]
    sample = values.column_sample(lineitem, 10_000, lineitem.count(), Workspace(spark))
    return sample.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


def profile_incremental(spark, sf_dir):
    """Profile of two thirds of two tables, after a third was counted and went again.

    The thirds are files in the scratch folder; the second refresh reads the new ones alone.
    """
    base, space = source(spark, sf_dir).tables, Workspace(spark)
    store = CountStore(spark, f"{space.root}/store")
    thirds = {"orders": "o_orderkey", "events": "event_id"}

    def put(table: str, third: int) -> None:
        part = base[table].filter(F.pmod(thirds[table], F.lit(3)) == third)
        part.write.parquet(f"{space.root}/files/{table}.parquet/third-{third}")

    def refreshed() -> Source:
        options = {"recursiveFileLookup": "true"}
        src = files_source(spark, f"{space.root}/files", list(thirds), db=DB, options=options)
        store.refresh(src, values.key_columns(src))
        return src

    for table in thirds:
        put(table, 0)
        put(table, 1)
    refreshed()
    for table in thirds:
        space.remove(f"{space.root}/files/{table}.parquet/third-0")
        put(table, 2)
    src = refreshed()
    profile = column_profile(store.counts(src, values.key_columns(src)))
    return named(spark, src, with_uniqueness(profile)).select(
        "table_name", "column_name", "row_count", "non_null", "distinct_values", "groups",
        "blanks", "ascii_rows", "is_unique",
    )


# -- candidates ------------------------------------------------------------------


def _classified(spark, sf_dir, policy, both_roles=True):
    profile = profiled(spark, source(spark, sf_dir), text_stats=policy == "ascii")
    return candidates.classify(profile, policy, both_roles)


def _pk_query(policy):
    def query(spark, sf_dir):
        return _classified(spark, sf_dir, policy).filter("pk").select(
            "table_name", "column_name", "row_count", "distinct_values"
        )

    return query


def _fk_query(policy, both_roles=True):
    def query(spark, sf_dir):
        return _classified(spark, sf_dir, policy, both_roles).filter("fk").select(
            "table_name", "column_name", "row_count", "distinct_values"
        )

    return query


def candidate_pairs(spark, sf_dir):
    columns = Workspace(spark).save(_classified(spark, sf_dir, "any"), "columns")
    pairs = candidates.candidate_pairs(columns.filter("fk"), columns.filter("pk"))
    return pairs.drop("fk", "pk")


# -- inclusion -------------------------------------------------------------------


def inclusion_misses(spark, sf_dir):
    src = source(spark, sf_dir)
    counts = Workspace(spark).save(values.value_counts(src, values.key_columns(src)), "counts")
    profile = candidates.classify(column_profile(counts).withColumn("is_text", F.lit(False)))
    roles = profile.select("cid", "row_count", "pk", "fk").collect()
    fks = [row["cid"] for row in roles if row["fk"]]
    pks = [row["cid"] for row in roles if row["pk"]]
    hits = inclusion.hits_by_pair(inclusion.shared_rows(counts, fks, pks))
    names = src.columns_frame(spark).select("cid", "table_name", "column_name")
    tested = metadata_frame(
        spark, [(row["cid"], row["row_count"]) for row in roles], "fk int, row_count bigint"
    )
    paired = (
        hits.join(tested, "fk")
        .join(names.toDF("fk", "fk_table", "fk_column"), "fk")
        .join(names.toDF("pk", "pk_table", "pk_column"), "pk")
        .filter("fk_table <> pk_table")
    )
    return inclusion.with_miss_ratio(paired, F.col("row_count")).drop("fk", "pk")


def column_ranges(spark, sf_dir):
    src = both_sources(spark, sf_dir)
    statistics = sketches.column_statistics(src, values.key_columns(src))
    return named(spark, src, statistics.drop("distinct_sketch"))


def footer_ranges(spark, sf_dir):
    """Counts and integer ranges, from footers as far as the tables are files."""
    src = both_sources(spark, sf_dir)
    src = replace(src, stored=source(spark, sf_dir).stored)
    stored = {name: (src.tables[name], path) for name, (_, path) in src.stored.items()}
    src = replace(src, stored=stored)
    return named(spark, src, counts_and_ranges(spark, src, values.key_columns(src)))


def pk_screened(spark, sf_dir):
    """Keys, counted in full only where statistics and sketches leave them possible."""
    src, space = source(spark, sf_dir), Workspace(spark)
    cols = values.key_columns(src)
    statistics = space.save(sketches.column_statistics(src, cols), "statistics")
    possible = statistics.filter(sketches.may_be_unique()).select(
        "cid", sketches.distinct_estimate().alias("estimate")
    )
    estimates = {row["cid"]: row["estimate"] for row in possible.collect()}
    screened = sketches.column_sketches(src, [c for c in cols if c.cid in estimates], estimates)
    left = {row["cid"] for row in screened.filter(~sketches.repeats()).select("cid").collect()}
    profile = column_profile(values.value_counts(src, [c for c in cols if c.cid in left]))
    return named(spark, src, profile.filter(candidates.is_pk())).select(
        "table_name", "column_name", "row_count", "distinct_values"
    )


INCLUSION_TOLERANCE = 0.05


def inclusion_rounds(spark, sf_dir):
    """Pairs within a tolerance with their misses, tested slice by slice."""
    src, space = source(spark, sf_dir), Workspace(spark)
    cols = {c.cid: c for c in values.key_columns(src)}
    keys = space.save(
        values.value_counts(src, list(cols.values()), slots=(0, values.SLOTS)), "counts"
    )
    profile = column_profile(keys).withColumn("is_text", F.lit(False))
    roles = candidates.classify(profile).select(
        "cid", "row_count", "distinct_values", "pk"
    ).collect()
    pks = [row["cid"] for row in roles if row["pk"]]
    few = values.grouped_first(
        list(cols.values()), {row["cid"]: row["distinct_values"] for row in roles}
    )
    rest = [row["cid"] for row in roles if not row["pk"]]
    rows = {row["cid"]: row["row_count"] for row in roles}
    everything = [(f, p) for f in cols for p in pks if cols[f].table != cols[p].table]

    def count(cids, slots):
        asked = [cols[cid] for cid in cids]
        whole, cut = [c for c in asked if c in few], [c for c in asked if c not in few]
        parts = []
        if whole:
            counted = values.value_counts(src, whole, slots=(0, values.SLOTS))
            parts.append(counted.filter(F.col("slot").between(slots[0], slots[1] - 1)))
        if cut:
            parts.append(values.value_counts(src, cut, slots=slots))
        return space.save(union_all(parts), "slice")

    tested = rounds.surviving_in_rounds(
        spark,
        metadata_frame(spark, everything, "fk int, pk int"),
        count,
        rest,
        keys.filter(F.col("cid").isin(pks)),
        rows,
        INCLUSION_TOLERANCE,
        space,
        rounds.rounds_for(INCLUSION_TOLERANCE),
    )
    names = src.columns_frame(spark).select("cid", "table_name", "column_name")
    counted = metadata_frame(spark, list(rows.items()), "fk int, row_count bigint")
    paired = (
        tested.pairs.join(counted, "fk")
        .join(names.toDF("fk", "fk_table", "fk_column"), "fk")
        .join(names.toDF("pk", "pk_table", "pk_column"), "pk")
    )
    return inclusion.with_miss_ratio(paired, F.col("row_count")).drop("fk", "pk")


# Keys 0 to NESTED - 1 of orders: key i has the orders whose number leaves i or less.
NESTED = 100


def inclusion_nested(spark, sf_dir):
    """Hits of each of many nested keys in each other, through the prefix tree."""
    least = F.pmod("o_orderkey", F.lit(NESTED)).cast("int")
    found = source(spark, sf_dir).tables["orders"].select(
        F.explode(F.sequence(least, F.lit(NESTED - 1))).alias("fk"),
        F.sequence(least, F.lit(NESTED - 1)).alias("_keys"),
        F.lit(1).cast("bigint").alias("cnt"),
    )
    space = Workspace(spark)
    per_set = space.save(inclusion.sums_per_set(found), "sets")
    return inclusion.hits_by_tree(per_set, space)


def _one_pair(probe):
    def query(spark, sf_dir):
        tables = source(spark, sf_dir).tables
        orders = tables["orders"].select("o_orderkey", "o_custkey")
        return probe(orders, "o_custkey", tables["supplier"], "s_suppkey")

    return query


# -- relations -------------------------------------------------------------------

U = Params.ungated
RELATIONS = {
    "relations_any": U(),
    "relations_unique": U(class_policy="unique_only"),
    "relations_ascii": U(class_policy="ascii"),
    "relations_mysql_types": U(type_policy="mysql"),
    "relations_default_params": Params(),
    "relations_tolerant": U(sup_out_foreign_key=0.05),
    "relations_role_bars": U(not_base_tables=("nation",), not_cite_tables=("lineitem",)),
    "relations_full": U(inf_tab_len=10, tables=TABLES),
    "relations_fixed_base": U(sup_out_foreign_key=0.05, ratio_base="fixed"),
    "relations_sampled": U(sample_rows=1_000, inf_dup_ratio=0.3),
}

# Discoveries that are registered a second time, on the plan for large data.
STAGED = ("relations_any", "relations_tolerant", "relations_ascii", "relations_sampled")


def _relations_query(params, **options):
    def query(spark, sf_dir):
        return discover(spark, source(spark, sf_dir), params, **options)

    return query


# Models of one shared discovery: other gates, roles, tables, tolerances and policies.
MANY_MODELS = {
    "plain": U(),
    "gated": Params(),
    "loose": U(sup_out_foreign_key=0.05, ratio_base="fixed"),
    "unique": U(class_policy="unique_only"),
    "ascii": U(class_policy="ascii", use_str_len=True, inf_str_len=0),
    "few": U(tables=("orders", "customer", "nation", "labels"), not_cite_tables=("labels",)),
    "typed": U(type_policy="mysql"),
}


def relations_many_models(spark, sf_dir):
    models = [replace(p, model_id=name) for name, p in MANY_MODELS.items()]
    return discover_many(spark, source(spark, sf_dir), models)


# -- results ---------------------------------------------------------------------


def _found(spark, sf_dir, name, **changes) -> DataFrame:
    """Relations in stored form, written once."""
    params = U(model_id=MODEL, **changes)
    found = discover(spark, source(spark, sf_dir), params)
    rows = results.result_rows(found, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return Workspace(spark).save(rows, name)


SHOWN = ("model", *results.RELATION_KEY, "status", "scantype", "matching_degree")


def relation_status(spark, sf_dir):
    current = _found(spark, sf_dir, "current")
    previous = current.filter("table1 < 'n'")
    return results.relation_status(current, previous).select(*SHOWN)


def relation_new(spark, sf_dir):
    current = _found(spark, sf_dir, "current")
    previous = current.filter("table1 < 'n'")
    return results.new_relations(current, previous).select(*SHOWN)


def relation_removed(spark, sf_dir):
    previous = _found(spark, sf_dir, "previous", sup_out_foreign_key=0.05)
    current = _found(spark, sf_dir, "current")
    return results.removed_relations(previous, current).select(*SHOWN)


def _stored(current: DataFrame) -> DataFrame:
    """An earlier state: known rows, rows of a user, rows of another model."""
    automatic = current.filter("table1 < 'n'")
    by_user = current.filter("table2 = 'nation'").withColumn("scantype", F.lit(1))
    edited = by_user.withColumn("status", F.lit(0))
    other = current.filter("table2 = 'orders'").withColumn("model", F.lit("m2"))
    return union_all([automatic, edited, other])


def relation_replace(spark, sf_dir):
    current = _found(spark, sf_dir, "current")
    stored = _stored(current)
    marked = results.relation_status(current, stored)
    models = metadata_frame(spark, [(MODEL,)], "model string")
    return results.replace_relations(stored, marked, models).select("id", *SHOWN)


def relation_history(spark, sf_dir):
    """Three runs: exact relations of the first tables, tolerant ones of all but nation, exact ones."""
    exact = _found(spark, sf_dir, "exact")
    tolerant = _found(spark, sf_dir, "tolerant", sup_out_foreign_key=0.05)
    runs = [exact.filter("table1 < 'o'"), tolerant.filter("table2 <> 'nation'"), exact]
    numbered = [frame.withColumn("run", F.lit(i + 1)) for i, frame in enumerate(runs)]
    return history.relation_history(union_all(numbered), [1, 2, 3])


def run_summary(spark, sf_dir):
    current = _found(spark, sf_dir, "current")
    stored = _stored(current)
    both = current.unionByName(current.withColumn("model", F.lit("m2")))
    return results.run_summary(results.relation_status(both, stored))


QUERIES = {
    "catalog_tables": catalog_tables,
    "catalog_subset": catalog_subset,
    "catalog_columns": catalog_columns,
    "catalog_commented_columns": catalog_commented_columns,
    "ddl_comment": ddl_comment,
    "resolve_params": resolve_params_query,
    "table_gate": table_gate,
    "column_name_gate": column_name_gate,
    "column_name_gate_by_table": column_name_gate_by_table,
    "column_name_gate_compat": column_name_gate_compat,
    "column_type_gate": column_type_gate,
    "column_type_gate_oracle": column_type_gate_oracle,
    "complete_columns": complete_columns,
    "gate_avg_len": gate_avg_len,
    "gate_distinct_ratio": gate_distinct_ratio,
    "gate_blank_ratio": gate_blank_ratio,
    "value_gate": value_gate,
    "table_row_counts": table_row_counts,
    "column_non_null": column_non_null,
    "column_distinct": column_distinct,
    "column_ascii": column_ascii,
    "column_profile": column_profile_query,
    "pk_values": pk_values,
    "keys_kept": keys_kept,
    "values_long": values_long,
    "profile_incremental": profile_incremental,
    "column_sample": column_sample,
    "pk_candidates": _pk_query("any"),
    "pk_candidates_ascii": _pk_query("ascii"),
    "fk_candidates_unique": _fk_query("unique_only"),
    "fk_candidates_ascii": _fk_query("ascii"),
    "fk_candidates_any": _fk_query("any"),
    "fk_candidates_single_role": _fk_query("any", both_roles=False),
    "candidate_pairs": candidate_pairs,
    "inclusion_misses": inclusion_misses,
    "inclusion_rounds": inclusion_rounds,
    "inclusion_nested": inclusion_nested,
    "column_ranges": column_ranges,
    "footer_ranges": footer_ranges,
    "pk_screened": pk_screened,
    "orphan_rows": _one_pair(inclusion.orphan_rows),
    "matched_rows": _one_pair(inclusion.matched_rows),
    **{name: _relations_query(params) for name, params in RELATIONS.items()},
    **{
        f"{name}_staged": _relations_query(RELATIONS[name], strategy="staged")
        for name in STAGED
    },
    "relation_status": relation_status,
    "relation_new": relation_new,
    "relation_removed": relation_removed,
    "relation_history": relation_history,
    "relations_many_models": relations_many_models,
    "relation_replace": relation_replace,
    "run_summary": run_summary,
}
