"""Run parameters and how they are resolved from a configuration table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two default sets, the default rules and the built-in limits.
DEFAULT_NAME_RULES = {"_": ["EXT_", "ext_"]}
NO_ROW_DEFAULTS = {"inf_dup_ratio": 0.3, "inf_str_len": 1, "inf_tab_len": 5}
NULL_FIELD_DEFAULTS = {"inf_dup_ratio": 0.4, "inf_str_len": 3, "inf_tab_len": 10}
SAMPLE_ROWS = 10_000
FIXED_RATIO_BASE = 10_000
MAX_ROWS = 100_000_000
MAX_BLANK_RATIO = 0.8
TYPE_POLICIES = {
    "mysql": ("VARCHAR", "DECIMAL", "CHAR", "TEXT", "INT"),
    "oracle": ("VARCHAR2", "CHAR", "VARCHAR", "NCHAR", "NVARCHAR2"),
    "all": None,
}

CLASS_POLICIES = ("any", "unique_only", "ascii")
RULES_MODES = ("documented", "compat")
RATIO_BASES = ("rows", "fixed")


@dataclass(frozen=True)
class Params:
    """Everything that steers one discovery run.

    The defaults are those of a run without a configuration row.  ``max_rows``
    is off by default because long tables spill instead of failing; set it to
    ``MAX_ROWS`` to turn long tables away.
    """

    model_id: str = "model"
    tables: tuple[str, ...] = ()
    name_rules: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: dict(DEFAULT_NAME_RULES)
    )
    rules_mode: str = "documented"
    type_policy: str = "all"
    class_policy: str = "any"
    both_roles: bool = True
    use_str_len: bool = False
    inf_str_len: int = NO_ROW_DEFAULTS["inf_str_len"]
    inf_dup_ratio: float = NO_ROW_DEFAULTS["inf_dup_ratio"]
    inf_tab_len: int = NO_ROW_DEFAULTS["inf_tab_len"]
    max_rows: int | None = None
    max_blank_ratio: float = MAX_BLANK_RATIO
    sup_out_foreign_key: float = 0.0
    ratio_base: str = "rows"
    sample_rows: int | None = None
    not_base_tables: tuple[str, ...] = ()
    not_cite_tables: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name, allowed in (
            ("type_policy", tuple(TYPE_POLICIES)),
            ("class_policy", CLASS_POLICIES),
            ("rules_mode", RULES_MODES),
            ("ratio_base", RATIO_BASES),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if self.sample_rows is not None and self.sample_rows < 1:
            raise ValueError("sample_rows must be positive")

    @classmethod
    def ungated(cls, **changes) -> Params:
        """No name rules and no value gates: every column takes part."""
        base = cls(name_rules={}, inf_dup_ratio=0.0, inf_str_len=0, inf_tab_len=0)
        return replace(base, **changes)

    @classmethod
    def from_row(cls, row, **changes) -> Params:
        """Parameters from one row of :func:`resolve_params`."""
        return cls(
            **{
                "model_id": row["model"],
                "tables": tuple(row["tables"]),
                "name_rules": {k: list(v) for k, v in row["name_rules"].items()},
                "use_str_len": row["use_str_len"],
                "inf_str_len": row["inf_str_len"],
                "inf_dup_ratio": row["inf_dup_ratio"],
                "inf_tab_len": row["inf_tab_len"],
                **changes,
            }
        )


def resolve_params(
    models: DataFrame, config: DataFrame, config_key: Column | None = None
) -> DataFrame:
    """One parameter row per model.

    ``models`` has ``model``; ``config`` has ``model, csl, ds, idr, isl, itl,
    tables1``.  ``config_key`` says how a model is spelled in ``config.model``.
    A model without a configuration row, or whose rule text cannot be read,
    gets the no-row defaults; a NULL field of a present row gets the
    NULL-field default.  Rules are read as JSON.
    """
    key = F.col("model") if config_key is None else config_key
    rules_type = "map<string,array<string>>"
    settings = config.select(
        F.col("model").alias("_key"),
        F.lit(True).alias("_found"),
        F.col("csl").cast("string").alias("_csl"),
        F.nullif(F.col("ds").cast("string"), F.lit("")).alias("_ds"),
        F.col("idr").cast("double").alias("_idr"),
        F.col("isl").cast("int").alias("_isl"),
        F.col("itl").cast("int").alias("_itl"),
        F.nullif(F.col("tables1").cast("string"), F.lit("")).alias("_tables"),
    ).withColumn("_rules", F.from_json("_ds", rules_type))
    joined = models.select("model", key.alias("_key")).join(settings, "_key", "left")
    usable = F.coalesce(F.col("_found"), F.lit(False)) & (
        F.col("_ds").isNull() | F.col("_rules").isNotNull()
    )
    default_rules = F.create_map(
        *[
            part
            for scope, rules in DEFAULT_NAME_RULES.items()
            for part in (F.lit(scope), F.array(*[F.lit(rule) for rule in rules]))
        ]
    )

    def numeric(source: str, name: str) -> Column:
        return (
            F.when(usable, F.coalesce(source, F.lit(NULL_FIELD_DEFAULTS[name])))
            .otherwise(F.lit(NO_ROW_DEFAULTS[name]))
            .alias(name)
        )

    return joined.select(
        "model",
        usable.alias("configured"),
        (F.coalesce(F.when(usable, F.col("_csl")), F.lit("0")) != "0").alias("use_str_len"),
        F.coalesce(F.when(usable, F.col("_rules")), default_rules).alias("name_rules"),
        numeric("_idr", "inf_dup_ratio"),
        numeric("_isl", "inf_str_len"),
        numeric("_itl", "inf_tab_len"),
        F.when(usable & F.col("_tables").isNotNull(), F.split("_tables", ","))
        .otherwise(F.array().cast("array<string>"))
        .alias("tables"),
    )
