"""Values in long form: which value occurs how often in which column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylink.functions.canonical import (
    INTEGRAL,
    TEXT,
    canonical_text,
    family,
    is_text,
    join_key,
    native_value,
    quoted,
    rendered,
)
from keylink.functions.frames import fresh_name, md5_of, union_all
from keylink.sources.catalog import ColumnInfo, Source
from keylink.sources.workspace import Workspace


def key_columns(source: Source) -> list[ColumnInfo]:
    """Columns whose type can hold key values at all."""
    return [c for c in source.columns() if family(c.dtype) is not None]


# Parts of the value space by hash; see ``value_counts``.
SLOTS = 64

# Columns with at most this many distinct values are grouped before their values are rendered.
FEW_VALUES = 1 << 20

# Tables below this many cells are read once, all columns as text: grouping
# them by native type would only add branches to the plan.
ONE_SCAN_CELLS = 1_000_000


def _scans(
    columns: Sequence[ColumnInfo], table_rows: Mapping[str, int]
) -> dict[tuple[str, str], list[ColumnInfo]]:
    """Columns grouped by (family, table): each group is one pruned scan."""
    by_table: dict[str, list[ColumnInfo]] = {}
    for item in columns:
        by_table.setdefault(item.table, []).append(item)
    scans: dict[tuple[str, str], list[ColumnInfo]] = {}
    for table, items in by_table.items():
        cells = len(items) * table_rows.get(table, ONE_SCAN_CELLS)
        for item in items:
            kind = TEXT if cells < ONE_SCAN_CELLS else family(item.dtype)
            scans.setdefault((kind, table), []).append(item)
    return scans


def _unpivot(
    frame: DataFrame, items: Sequence[ColumnInfo], parts, names, beside: Sequence[str] = ()
) -> DataFrame:
    """(beside..., cid, parts...) of several columns by one Generate, without a shuffle."""
    labels = ", ".join(("cid", *names))
    cells = ", ".join(f"{c.cid}, {', '.join(parts(c))}" for c in items)
    return frame.selectExpr(*beside, f"stack({len(items)}, {cells}) AS ({labels})")


def slot_of(c: ColumnInfo) -> str:
    """The part of the value space a cell belongs to; equal values have equal slots."""
    return f"pmod(xxhash64({canonical_text(c.name, c.dtype)}), {SLOTS})"


def dear_to_render(c: ColumnInfo) -> bool:
    """Whether the text of a cell costs far more than grouping it: doubles, decimals, times."""
    return family(c.dtype) not in (INTEGRAL, TEXT)


def grouped_first(
    columns: Sequence[ColumnInfo], distinct: Mapping[int, int], few: int | None = None
) -> list[ColumnInfo]:
    """Columns of few values (``distinct``, by ``cid``) whose cells are dear to render.

    To tell the slot of a cell its text is needed.  These columns are better counted in all slots,
    where only distinct values are rendered, and cut down to the slots in question afterwards.
    """
    few = FEW_VALUES if few is None else few
    return [c for c in columns if dear_to_render(c) and distinct.get(c.cid, few + 1) <= few]


def value_counts(
    source: Source,
    columns: Sequence[ColumnInfo],
    text_stats: bool = False,
    table_rows: Mapping[str, int] | None = None,
    slots: tuple[int, int] | None = None,
    apart: Mapping[str, str] | None = None,
) -> DataFrame:
    """``cid, v, cnt``: every distinct value of every column with its row count.

    Columns of one family share one aggregation on ``(cid, native value)``, so
    the shuffle carries numbers as numbers and each map task sends a hot value
    once.  With ``text_stats`` the length in characters (``chars``) and whether
    the value is plain ASCII (``ascii``) come along, measured on the whole text.
    ``table_rows``, where known, keeps the plan short for small tables.  With
    ``slots`` only values of those slots (first, end) are counted, others are
    dropped in the scan; ``slot`` comes along.  Where all slots are asked for,
    those of numbers and times are worked out after the grouping, once a value.  ``apart`` names expressions over
    the rows of a table (such as their file) by which they are counted apart.
    """
    apart = apart or {}
    late = slots == (0, SLOTS)
    beside = [f"{sql} AS {name}" for name, sql in apart.items()]
    grouped: dict[str, list[DataFrame]] = {}
    for (kind, table), items in _scans(columns, table_rows or {}).items():
        frame = source.tables[table]
        if kind == TEXT and text_stats:
            parts, names = _key_and_lengths, ("x", "chars", "octets")
        elif kind == TEXT:
            parts, names = lambda c: (join_key(c.name, c.dtype),), ("x",)
        else:
            parts, names = lambda c: (native_value(c.name, c.dtype),), ("x",)
        if slots is None or (late and kind != TEXT):
            long = _unpivot(frame, items, parts, names, beside)
        else:
            long = _in_slots(frame, items, parts, names, slots, beside)
        grouped.setdefault(kind, []).append(long)
    counted = []
    for kind, parts in grouped.items():
        aggregates = [F.count(F.lit(1)).alias("cnt")]
        if text_stats and kind == TEXT:
            aggregates += [F.max("chars").alias("chars"), F.max("octets").alias("octets")]
        text = rendered("x", kind)
        out = [*apart, "cid", f"{text} AS v", "cnt"]
        if late and kind != TEXT:
            out.append(f"pmod(xxhash64({text}), {SLOTS}) AS slot")
        elif slots is not None:
            aggregates.append(F.max("slot").alias("slot"))
            out.append("slot")
        counts = union_all(parts).groupBy(*apart, "cid", "x").agg(*aggregates)
        if text_stats and kind == TEXT:
            out += ["chars", "coalesce(chars = octets, false) AS ascii"]
        elif text_stats:
            out += [f"char_length({text}) AS chars", "x IS NOT NULL AS ascii"]
        counted.append(counts.selectExpr(*out))
    return union_all(counted)


def _in_slots(
    frame: DataFrame, items, parts, names, slots: tuple[int, int], beside: Sequence[str]
) -> DataFrame:
    """As ``_unpivot``; a cell of another slot is dropped before its parts are worked out."""
    first, end = slots

    def guarded(c: ColumnInfo):
        inside = f"{slot_of(c)} BETWEEN {first} AND {end - 1}"
        return (slot_of(c), *[f"CASE WHEN {inside} THEN {part} END" for part in parts(c)])

    if slots == (0, SLOTS):
        return _unpivot(frame, items, lambda c: (slot_of(c), *parts(c)), ("slot", *names), beside)
    return _unpivot(frame, items, guarded, ("slot", *names), beside).filter(
        F.col("slot").between(first, end - 1)
    )


def _key_and_lengths(c: ColumnInfo) -> tuple[str, str, str]:
    text = canonical_text(c.name, c.dtype)
    return join_key(c.name, c.dtype), f"char_length({text})", f"octet_length({text})"


def values_long(source: Source, columns: Sequence[ColumnInfo]) -> DataFrame:
    """``cid, v`` with one row per cell; ``v`` is the whole canonical text."""
    by_table: dict[str, list[ColumnInfo]] = {}
    for item in columns:
        by_table.setdefault(item.table, []).append(item)
    return union_all(
        [
            _unpivot(
                source.tables[table],
                items,
                lambda c: (canonical_text(c.name, c.dtype),),
                ("v",),
            )
            for table, items in by_table.items()
        ]
    )


def pk_values(source: Source, columns: Sequence[ColumnInfo]) -> DataFrame:
    """``cid, v``: the whole values of key columns; unique, so nothing is shuffled."""
    return values_long(source, columns)


def sample_key_columns(frame: DataFrame) -> list[str]:
    """Integer and text columns: what the repeatable sample order hashes."""
    return [
        item.name
        for item in frame.schema.fields
        if is_text(item.dataType) or family(item.dataType) == INTEGRAL
    ]


def column_sample(
    frame: DataFrame, rows: int, total: int | None = None, workspace: Workspace | None = None
) -> DataFrame:
    """The ``rows`` rows with the lowest md5 over their integers and texts.

    The order is the same on every run; rows that agree in those columns are
    ordered by the others.  Given ``total`` (the row count of ``frame``) and a
    ``workspace``, one pass keeps the rows below a cut that is expected to hold
    slightly more than ``rows`` of them, and the top-n sees only these rather
    than ``rows`` from each task.  Copies share one hash and may leave too few
    rows below the cut; then the whole table is ranked.
    """
    names = sample_key_columns(frame) or frame.columns
    others = [
        F.col(quoted(item.name)).asc_nulls_first()
        for item in frame.schema.fields
        if item.name not in names and family(item.dataType) is not None
    ]
    order = fresh_name("_h", frame.columns)
    ranked = frame.withColumn(order, md5_of([F.col(quoted(n)) for n in names]))
    if total is not None and workspace is not None and total > 4 * rows:
        share = (rows + 6 * rows**0.5 + 50) / total
        cut = f"{int(2**32 * min(share, 1 - 2**-32)):08x}"
        low = workspace.save(ranked.filter(F.col(order) < cut), "sample")
        if low.count() >= rows:
            ranked = low
    return ranked.orderBy(order, *others).limit(rows).drop(order)
