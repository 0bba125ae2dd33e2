"""Discovery of key relations between the tables of one source.

The driver handles metadata only: names, types, row counts, per-column numbers.
Values stay in Spark and are shuffled by ``(column, value)`` once to count them
and by ``value`` once to test inclusion.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keylink.functions.canonical import is_text, quoted
from keylink.functions.frames import metadata_frame, union_all
from keylink.operators.candidates import candidate_pairs, classify
from keylink.operators.gates import column_name_gate, column_type_gate, table_gate, value_gate
from keylink.operators.inclusion import (
    accepted,
    hits_by_pair,
    separate_rows,
    shared_rows,
    with_miss_ratio,
)
from keylink.operators.profile import column_profile
from keylink.operators.rounds import rounds_for, surviving_in_rounds
from keylink.operators.samples import sampled_counts
from keylink.operators.sketches import (
    column_sketches,
    column_statistics,
    distinct_estimate,
    may_be_unique,
    repeats,
    surviving_pairs,
)
from keylink.operators.values import (
    FEW_VALUES,
    SLOTS,
    column_sample,
    grouped_first,
    key_columns,
    value_counts,
)
from keylink.params import FIXED_RATIO_BASE, Params
from keylink.sources.catalog import ColumnInfo, Source, table_row_counts
from keylink.sources.counts import CountStore, from_files
from keylink.sources.footers import from_footers, no_key
from keylink.sources.workspace import Workspace

log = logging.getLogger(__name__)

RELATION_COLUMNS = (
    "model1", "db1", "table1", "table1comment", "column1", "column1comment",
    "model2", "db2", "table2", "table2comment", "column2", "column2comment",
    "matching_degree",
)

# Below this many cells one pass over all columns costs less than the extra stages.
STAGED_FROM_CELLS = 100_000_000

# From there on all columns are still counted at once where at most this share of the cells of columns
# that are no keys has to be shuffled for it: sketches and rounds look at each cell about four times.
SHUFFLED_SHARE = 1 / 3

STRATEGIES = ("auto", "staged", "oneshot")

_ROLE_SCHEMA = T.StructType(
    [
        T.StructField("cid", T.IntegerType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("table_comment", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("column_comment", T.StringType()),
        T.StructField("tested", T.LongType()),
    ]
)


def discover(
    spark: SparkSession,
    source: Source,
    params: Params | None = None,
    workspace: Workspace | None = None,
    strategy: str = "auto",
    store: CountStore | None = None,
) -> DataFrame:
    """Relations of ``source`` as a 13-column DataFrame.

    ``staged`` rules out keys and pairs by sketches, counts the columns that may
    be keys, and tests the other columns in rounds that leave out what already
    misses every key too often; ``oneshot`` counts all columns at once.  Both
    give the same rows; ``auto`` goes by the number of cells and, where these are
    many, by how few values they hold as far as statistics show.  With a ``store``
    whole columns of tables that are read from files are counted file by file,
    and files that an earlier run has counted are not read for it again.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    params = params or Params()
    run = _Run(spark, source, params, workspace or Workspace(spark), store)
    run.gate_tables_and_columns()
    if not run.eligible:
        return run.relations(None)
    staged = strategy == "staged" or (strategy == "auto" and run.cells() >= STAGED_FROM_CELLS)
    if staged:
        run.look_at_footers()
        run.take_statistics(all_columns=params.sample_rows is None)
    if staged and strategy == "auto" and run.counts_are_few():
        staged, run.not_keys = False, set()
    if staged and params.sample_rows is None:
        run.refute_pairs()
    if params.sample_rows is not None and params.class_policy == "any":
        run.sample_first()
    run.count_possible_keys(with_slots=staged)
    if params.sample_rows is not None:
        run.count_samples()
    else:
        run.count_references(staged)
    return run.relations(run.hits())


def discover_many(
    spark: SparkSession,
    source: Source,
    models: Sequence[Params],
    workspace: Workspace | None = None,
    store: CountStore | None = None,
) -> DataFrame:
    """Relations of several models, as if each were discovered alone.

    Every column that some model admits is counted once, and values meet once for
    all models; gates, roles and tolerances then apply model by model to profiles
    and hits, which are catalog-sized.  Models that test samples count their own.
    """
    workspace = workspace or Workspace(spark)
    results = [
        discover(spark, source, p, workspace, store=store) for p in models if p.sample_rows is not None
    ]
    runs = [
        _Run(spark, source, p, workspace, store, whole=True) for p in models if p.sample_rows is None
    ]
    if runs and source.tables:
        rows = workspace.save(table_row_counts(source), "rows")
        for run in runs:
            run.gate_tables_and_columns(rows)
    eligible = {c.cid: c for run in runs for c in run.eligible}
    hits = None
    if eligible:
        first = runs[0]
        table_rows = {t: n for run in runs for t, n in run.table_rows.items()}
        stats = any(run.text_stats() for run in runs)
        counts = first.save_counts(source, list(eligible.values()), "counts", None, table_rows, stats)
        profile = workspace.save(column_profile(counts), "profile")
        for run in runs:
            cids = [c.cid for c in run.eligible]
            run.take_profiles(profile.filter(F.col("cid").isin(cids)), profiled=True)
        fks, pks = ({cid for run in runs for cid in getattr(run, role)} for role in ("fks", "pks"))
        if fks and pks:
            met = hits_by_pair(shared_rows(counts, sorted(fks), sorted(pks)), len(pks), workspace)
            hits = workspace.save(met, "hits")
    return union_all([*results, *[run.relations(hits) for run in runs]])


class _Run:
    """State of one run: column metadata on the driver, values in the workspace."""

    def __init__(self, spark, source: Source, params: Params, workspace: Workspace, store=None, whole=False):
        """``whole`` keeps all tables in the source, so that runs number columns alike."""
        self.spark = spark
        self.store: CountStore | None = store
        self.params = params
        self.workspace = workspace
        missing = source.unknown(params.tables)
        if missing:
            log.warning("unknown tables left out: %s", ", ".join(missing))
        self.source = source.subset(params.tables) if params.tables and not whole else source
        self.columns = {c.cid: c for c in self.source.columns()}
        self.eligible: list[ColumnInfo] = []
        self.table_rows: dict[str, int] = {}
        self.not_keys: set[int] = set()
        self.estimates: dict[int, int] = {}
        self.statistics: DataFrame | None = None
        self.pairs: DataFrame | None = None
        self.sample_counts: DataFrame | None = None
        self.in_pairs: set[int] | None = None
        self.tested_pairs: DataFrame | None = None
        self.columns_read: tuple[tuple[int, ...], ...] = ()
        self.pks: list[int] = []
        self.fks: list[int] = []
        self.tested: dict[int, int] = {}
        self.distinct: dict[int, int] = {}
        self.key_counts: DataFrame | None = None
        self.fk_counts: DataFrame | None = None

    # -- metadata gates ------------------------------------------------------

    def gate_tables_and_columns(self, counted: DataFrame | None = None) -> None:
        if not self.source.tables:
            return
        p = self.params
        counted = table_row_counts(self.source) if counted is None else counted
        if p.tables:
            counted = counted.filter(F.col("table_name").isin(list(p.tables)))
        gated = table_gate(counted, p.inf_tab_len, p.max_rows).collect()
        for row in gated:
            if row["reason"] == "ok":
                self.table_rows[row["table_name"]] = row["row_count"]
            else:
                log.info("table %s left out: %s", row["table_name"], row["reason"])
        catalog = self.source.columns_frame(self.spark)
        named = column_name_gate(self.spark, catalog, p.name_rules, p.rules_mode)
        kept = column_type_gate(named, p.type_policy).filter("name_kept AND type_kept")
        cids = {row["cid"] for row in kept.select("cid").collect()}
        self.eligible = [
            c for c in self.columns.values() if c.cid in cids and c.table in self.table_rows
        ]

    def cells(self) -> int:
        return sum(self.table_rows[c.table] for c in self.eligible)

    def text_stats(self) -> bool:
        return self.params.use_str_len or self.params.class_policy == "ascii"

    def may_be_key(self, c: ColumnInfo) -> bool:
        return c.table not in self.params.not_base_tables

    def may_refer(self, c: ColumnInfo) -> bool:
        return c.table not in self.params.not_cite_tables

    # -- before any value is shuffled ------------------------------------------

    def look_at_footers(self) -> None:
        """Rules out keys by what Parquet footers say of them; reads no values."""
        found, _ = from_footers(self.spark, self.source, self.eligible)
        self.not_keys |= {row[0] for row in found if no_key(row)}

    def take_statistics(self, all_columns: bool) -> None:
        """Rows, NULLs and estimates of distinct values; rules out keys."""
        asked = [c for c in self.eligible if all_columns or c.cid not in self.not_keys]
        if not asked:
            return
        self.statistics = self.workspace.save(column_statistics(self.source, asked), "statistics")
        judged = self.statistics.select(
            "cid", may_be_unique().alias("possible"), distinct_estimate().alias("estimate")
        )
        for row in judged.collect():
            self.estimates[row["cid"]] = row["estimate"]
            if not row["possible"]:
                self.not_keys.add(row["cid"])

    def counts_are_few(self) -> bool:
        """Whether counting all columns at once shuffles few rows for the cells it reads.

        Within so many rows a task sends a value once; a column of more values is taken to send
        every row.  Columns that may be keys are left out, as they are counted in either plan.
        """
        if self.params.sample_rows is not None or self.params.class_policy != "any":
            return False
        read = shuffled = 0
        for c in self.eligible:
            if c.cid in self.not_keys:
                rows, distinct = self.table_rows[c.table], self.estimates[c.cid]
                sent = rows if distinct > FEW_VALUES else distinct * -(-rows // FEW_VALUES)
                read += rows
                shuffled += min(rows, sent)
        return shuffled <= read * SHUFFLED_SHARE

    def refute_pairs(self) -> None:
        """Drops keys with repeats and pairs with too many misses, as far as sketches show them."""
        sketches = self.workspace.save(
            column_sketches(self.source, self.eligible, self.estimates), "sketches"
        )
        self.not_keys |= {row["cid"] for row in sketches.filter(repeats()).select("cid").collect()}
        possible = [c for c in self.eligible if c.cid not in self.not_keys]
        policy = self.params.class_policy
        refs = [
            c for c in self.eligible
            if self.may_refer(c)
            and (policy == "any" or c.cid not in self.not_keys
                 or (policy == "ascii" and is_text(c.dtype)))
        ]
        pairs = surviving_pairs(
            self.spark,
            sketches,
            self.statistics,
            [(c.cid, c.table, float(self.ratio_base(c))) for c in refs],
            [(c.cid, c.table) for c in possible if self.may_be_key(c)],
            self.params.sup_out_foreign_key,
            self.workspace,
        )
        self.pairs = self.workspace.save(pairs, "pairs")
        alive = self.pairs.agg(
            F.collect_set("fk").alias("fks"), F.collect_set("pk").alias("pks")
        ).first()
        self.in_pairs = {*alive["fks"], *alive["pks"]}

    def sample_first(self) -> None:
        """Counts the samples, which are tested later on; a repeat or a NULL in them rules keys out."""
        refs = [c for c in self.eligible if self.may_refer(c)]
        if refs:
            self.sample_counts = self.counts_of_samples(refs)
            shown = self.sample_counts.filter("v IS NULL OR cnt > 1").select("cid").distinct()
            self.not_keys |= {row["cid"] for row in shown.collect()}

    # -- keys ----------------------------------------------------------------

    def count_possible_keys(self, with_slots: bool) -> None:
        """Counts all columns that may be unique and picks the keys among them."""
        # Barred tables are counted as well: whether their columns are unique
        # decides which of them may refer.
        possible = [
            c for c in self.eligible
            if c.cid not in self.not_keys and (self.in_pairs is None or c.cid in self.in_pairs)
        ]
        if possible:
            self.key_counts = self.save_counts(
                self.source, possible, "keys", (0, SLOTS) if with_slots else None
            )
            self.take_profiles(self.key_counts)

    # -- referencing columns ---------------------------------------------------

    def count_references(self, staged: bool) -> None:
        """Counts the referencing columns that are still in question."""
        counted = set(self.distinct)
        rest = [c for c in self.eligible if c.cid not in counted and self.may_refer(c)]
        if self.params.class_policy == "unique_only" or not self.pks:
            rest = []
        elif self.params.class_policy == "ascii":
            rest = [c for c in rest if is_text(c.dtype)]
        if staged:
            more = self.test_in_rounds(rest)
        else:
            more = self.save_counts(self.source, rest, "references") if rest else None
        self.fk_counts = self.key_counts
        if more is not None:
            self.take_profiles(more, keys=False)
            parts = [frame for frame in (self.key_counts, more) if frame is not None]
            self.fk_counts = union_all([part.select("cid", "v", "cnt") for part in parts])

    def test_in_rounds(self, rest: Sequence[ColumnInfo]) -> DataFrame | None:
        """Tests the surviving pairs; returns the counts of the columns of ``rest`` that pass."""
        if not self.pks:
            return None
        refs = {*self.fks, *[c.cid for c in rest]}
        pairs = self.pairs.filter(
            F.col("pk").isin(self.pks) & F.col("fk").isin(sorted(refs))
        )

        def count(cids: Sequence[int], slots: tuple[int, int]) -> DataFrame:
            columns = [self.columns[cid] for cid in cids]
            return self.save_counts(self.source, columns, "slice", slots)

        tested = surviving_in_rounds(
            self.spark,
            pairs,
            count,
            [c.cid for c in rest],
            self.key_counts,
            {cid: float(self.ratio_base(self.columns[cid])) for cid in refs},
            self.params.sup_out_foreign_key,
            self.workspace,
            rounds_for(self.params.sup_out_foreign_key, self.params.ratio_base) if rest else ((0, SLOTS),),
        )
        self.tested_pairs, self.columns_read = tested.pairs, tested.read
        alive = tested.pairs.agg(F.collect_set("fk").alias("fks")).first()["fks"]
        self.fks = [cid for cid in self.fks if cid in alive]
        if tested.counts is None:
            return None
        passed = [c.cid for c in rest if c.cid in alive]
        return tested.counts.filter(F.col("cid").isin(passed)) if passed else None

    def count_samples(self) -> None:
        """Gates and tests a repeatable sample of every table instead of all rows."""
        refs = [c for c in self.eligible if self.may_refer(c)]
        if self.params.class_policy == "ascii":
            self.profile_uncounted_text(refs)
        allowed = set(self.fks)
        if self.params.class_policy == "any":
            allowed |= {c.cid for c in refs} - set(self.distinct)
        refs = [c for c in refs if c.cid in allowed]
        if not refs or not self.pks:
            self.fks = []
            return
        if self.sample_counts is None:
            self.fk_counts = self.counts_of_samples(refs)
        else:
            self.fk_counts = self.sample_counts.filter(F.col("cid").isin([c.cid for c in refs]))
        self.fks = []
        for row in self.gated_profile(self.fk_counts):
            self.tested[row["cid"]] = row["row_count"]
            if row["reject_reason"] is None:
                self.fks.append(row["cid"])

    def counts_of_samples(self, refs: Sequence[ColumnInfo]) -> DataFrame:
        """Counts of the samples of all tables at once, where lengths of texts aren't asked for."""
        parts, rest = [], refs
        if not self.text_stats():
            hashed = {
                c.table: [x.name for x in self.eligible if x.table == c.table] for c in refs
            }
            done = sampled_counts(
                self.source, refs, hashed, self.params.sample_rows, self.table_rows, self.workspace
            )
            rest = [c for c in refs if c.table in done.unsettled]
            if done.counts is not None:
                parts.append(done.counts)
        if rest:
            sampled = self.samples_of({c.table for c in rest})
            sample = replace(self.source, tables={**self.source.tables, **sampled})
            parts.append(self.save_counts(sample, rest, "sample"))
        if rest == refs:
            return parts[0]
        counts = [part.select("cid", "v", "cnt") for part in parts]
        return self.workspace.save(union_all(counts), "samples")

    def samples_of(self, tables: set[str]) -> dict[str, DataFrame]:
        def sample(table: str) -> DataFrame:
            frame = self.source.tables[table].select(
                *[quoted(c.name) for c in self.eligible if c.table == table]
            )
            return column_sample(
                frame, self.params.sample_rows, self.table_rows[table], self.workspace
            )

        with ThreadPoolExecutor(max_workers=8) as pool:
            return dict(zip(tables, pool.map(sample, tables), strict=True))

    def profile_uncounted_text(self, refs: Sequence[ColumnInfo]) -> None:
        rest = [c for c in refs if c.cid not in self.distinct]
        if rest:
            counts = self.save_counts(self.source, rest, "text")
            self.take_profiles(counts, keys=False)

    # -- shared steps ------------------------------------------------------------

    def ratio_base(self, c: ColumnInfo) -> int:
        if self.params.ratio_base == "fixed":
            return FIXED_RATIO_BASE
        return self.table_rows[c.table]

    def save_counts(
        self,
        source: Source,
        columns: Sequence[ColumnInfo],
        name: str,
        slots: tuple[int, int] | None = None,
        rows: Mapping[str, int] | None = None,
        text_stats: bool | None = None,
    ) -> DataFrame:
        rows = self.table_rows if rows is None else rows
        text_stats = self.text_stats() if text_stats is None else text_stats
        if self.params.sample_rows is not None and source is not self.source:
            rows = {table: min(count, self.params.sample_rows) for table, count in rows.items()}
        kept = [
            c for c in columns
            if self.store is not None and source is self.source and from_files(source.tables[c.table])
        ]
        rest = [c for c in columns if c not in kept]
        parts = []
        if kept:
            # Whole tables, so that a file is counted once whichever columns a run asks for.
            tables = {c.table for c in kept}
            whole = [c for c in key_columns(self.source) if c.table in tables]
            self.store.refresh(self.source, whole)
            counted = self.store.counts(self.source, whole, slots)
            parts.append(counted.filter(F.col("cid").isin([c.cid for c in kept])))
        if rest and slots not in (None, (0, SLOTS)):
            few = grouped_first(rest, self.estimates)
            if few:
                whole = value_counts(source, few, text_stats, rows, (0, SLOTS))
                parts.append(whole.filter(F.col("slot").between(slots[0], slots[1] - 1)))
                rest = [c for c in rest if c not in few]
        if rest:
            parts.append(value_counts(source, rest, text_stats, rows, slots))
        shared = [name for name in parts[0].columns if all(name in p.columns for p in parts)]
        return self.workspace.save(union_all([part.select(*shared) for part in parts]), name)

    def gated_profile(self, counts: DataFrame, profiled: bool = False) -> list:
        """One row per counted column: profile, roles and gate (catalog-sized)."""
        p = self.params
        catalog = self.source.columns_frame(self.spark).select("cid", "is_text")
        profile = counts if profiled else column_profile(counts)
        return value_gate(
            classify(profile.join(catalog, "cid"), p.class_policy, p.both_roles),
            p.use_str_len,
            p.inf_str_len,
            p.inf_dup_ratio,
            p.max_blank_ratio,
        ).collect()

    def take_profiles(self, counts: DataFrame, keys: bool = True, profiled: bool = False) -> None:
        gates_apply = self.params.sample_rows is None
        for row in self.gated_profile(counts, profiled):
            c = self.columns[row["cid"]]
            self.distinct[c.cid] = row["distinct_values"]
            self.tested[c.cid] = row["row_count"]
            if keys and row["pk"] and self.may_be_key(c):
                self.pks.append(c.cid)
            passed = row["reject_reason"] is None or not gates_apply
            if row["fk"] and passed and self.may_refer(c):
                self.fks.append(c.cid)

    def hits(self) -> DataFrame | None:
        """``fk, pk, hits`` of all candidate columns."""
        if not self.fks or not self.pks:
            return None
        if self.tested_pairs is not None:
            return self.tested_pairs
        keys = self.key_counts.select("cid", "v", "cnt")
        if self.params.sample_rows is not None:
            rows = separate_rows(self.fk_counts, self.fks, keys, self.pks)
        else:
            rows = shared_rows(self.fk_counts, self.fks, self.pks)
        return hits_by_pair(rows, len(self.pks), self.workspace)

    def role_frame(self, cids: Sequence[int]) -> DataFrame:
        comments = self.source.table_comments
        rows = [
            (
                cid,
                self.columns[cid].table,
                comments.get(self.columns[cid].table) or "",
                self.columns[cid].name,
                self.columns[cid].comment,
                self.tested.get(cid),
            )
            for cid in cids
        ]
        return metadata_frame(self.spark, rows, _ROLE_SCHEMA)

    def relations(self, hits: DataFrame | None) -> DataFrame:
        p = self.params
        fk_frame, pk_frame = self.role_frame(self.fks), self.role_frame(self.pks)
        if hits is None:
            hits = metadata_frame(self.spark, [], "fk int, pk int, hits bigint")
        # Columns so short, or a tolerance so wide, that no hit is needed at all.
        hitless = [
            cid
            for cid in self.fks
            if self.tested[cid]
            / (FIXED_RATIO_BASE if p.ratio_base == "fixed" else self.tested[cid])
            <= p.sup_out_foreign_key
        ]
        if hitless:
            pairs = candidate_pairs(self.role_frame(hitless), pk_frame).select("fk", "pk")
            hits = hits.join(pairs, ["fk", "pk"], "full").withColumn(
                "hits", F.coalesce("hits", F.lit(0))
            )
        joined = (
            hits.join(fk_frame.withColumnRenamed("cid", "fk").alias("f"), "fk")
            .join(pk_frame.withColumnRenamed("cid", "pk").alias("p"), "pk")
            .filter(F.col("f.table_name") != F.col("p.table_name"))
        )
        scored = accepted(
            with_miss_ratio(joined, F.col("f.tested"), p.ratio_base), p.sup_out_foreign_key
        )
        model, db = F.lit(p.model_id), F.lit(self.source.db)
        return scored.select(
            model.alias("model1"),
            db.alias("db1"),
            F.col("p.table_name").alias("table1"),
            F.col("p.table_comment").alias("table1comment"),
            F.col("p.column_name").alias("column1"),
            F.col("p.column_comment").alias("column1comment"),
            model.alias("model2"),
            db.alias("db2"),
            F.col("f.table_name").alias("table2"),
            F.col("f.table_comment").alias("table2comment"),
            F.col("f.column_name").alias("column2"),
            F.col("f.column_comment").alias("column2comment"),
            F.col("miss_ratio").alias("matching_degree"),
        )
