"""DuckDB statements that compute what the registered queries compute.

The statements are put together from the column list of the test tables; no
Spark result goes into them.  Inclusion is checked by a plain self join of the
value counts, pair by pair.
"""

from __future__ import annotations

from checks.queries import (
    CONFIG_COLUMNS,
    INCLUSION_TOLERANCE,
    MANY_MODELS,
    MODEL,
    NAME_RULES,
    NESTED,
    RELATIONS,
    STAGED,
    TABLE_RULES,
)
from checks.tables import (
    COLUMN_COMMENTS,
    DB,
    OPTIONAL,
    TABLE_COMMENTS,
    TABLES,
    columns_of,
    type_class,
)
from keylink.params import (
    DEFAULT_NAME_RULES,
    FIXED_RATIO_BASE,
    NO_ROW_DEFAULTS,
    NULL_FIELD_DEFAULTS,
    TYPE_POLICIES,
)

BOTH = (*TABLES, *OPTIONAL)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def frame_of(table: str) -> str:
    """FROM item of a test table or an optional table."""
    if table not in OPTIONAL:
        return table
    base, columns = OPTIONAL[table]
    return "(SELECT " + ", ".join(f"{sql} AS {c}" for c, (sql, _) in columns.items()) + (
        f" FROM {base})"
    )


def columns(tables, other=False):
    """(cid, table, column, type, ordinal), numbered over all columns."""
    found, cid = [], 0
    for table in tables:
        for ordinal, (name, kind) in enumerate(columns_of(table)):
            cls = type_class(kind)
            if other or cls != "other":
                found.append((cid, table, name, kind, ordinal))
            cid += 1
    return found


def meta(cols) -> str:
    rows = ", ".join(
        f"({cid}, {text(t)}, {text(c)}, {text(kind)}, {text(type_class(kind))}, "
        f"{str(kind == 'VARCHAR').lower()}, {ordinal}, {text(TABLE_COMMENTS.get(t, ''))}, "
        f"{text(COLUMN_COMMENTS.get((t, c), ''))})"
        for cid, t, c, kind, ordinal in cols
    )
    return (
        f"meta(cid, table_name, column_name, type_name, type_class, is_text, ordinal, "
        f"table_comment, column_comment) AS (VALUES {rows})"
    )


def real_text(c: str) -> str:
    """The text of a double as the JVM writes it: E notation from 10**7 on and below 10**-3."""
    t = f"CAST({c} AS VARCHAR)"
    mantissa = f"replace(split_part({t}, 'e', 1), '-', '')"
    whole = f"ltrim(split_part({mantissa}, '.', 1), '0')"
    part = f"split_part({mantissa}, '.', 2)"
    shift = f"coalesce(try_cast(split_part({t}, 'e', 2) AS INTEGER), 0)"
    digits = f"rtrim(ltrim(replace({mantissa}, '.', ''), '0'), '0')"
    exponent = (
        f"({shift} + CASE WHEN {whole} <> '' THEN length({whole}) - 1 "
        f"ELSE length(ltrim({part}, '0')) - length({part}) - 1 END)"
    )
    return (
        f"CASE WHEN {c} = 0 THEN '0.0' WHEN abs({c}) >= 1e-3 AND abs({c}) < 1e7 THEN {t} "
        f"ELSE concat(CASE WHEN {c} < 0 THEN '-' ELSE '' END, left({digits}, 1), '.', "
        f"CASE WHEN length({digits}) > 1 THEN substr({digits}, 2) ELSE '0' END, 'E', {exponent}) "
        "END"
    )


def cell_text(c: str, kind: str) -> str:
    return real_text(c) if type_class(kind) == "floating" else f"CAST({c} AS VARCHAR)"


def cells(cols, sampled: int | None = None) -> str:
    """CTE u: one row per cell with its text."""
    parts = []
    for cid, t, c, kind, _ in cols:
        origin = sample_of(t, cols, sampled) if sampled else frame_of(t)
        parts.append(f"SELECT {cid} AS cid, {cell_text(c, kind)} AS v FROM {origin} x{cid}")
    return "u AS (" + " UNION ALL ".join(parts) + ")"


def sample_of(table: str, cols, rows: int) -> str:
    own = [(c, kind) for _, t, c, kind, _ in cols if t == table]
    keys = [c for c, kind in own if type_class(kind) == "integral" or kind == "VARCHAR"]
    order = [md5_of(keys), *[f"{c} ASC NULLS FIRST" for c, _ in own if c not in keys]]
    return f"(SELECT * FROM {table} ORDER BY {', '.join(order)} LIMIT {rows})"


def md5_of(names) -> str:
    parts = ", ".join(f"coalesce(CAST({n} AS VARCHAR), '\\N')" for n in names)
    return f"md5(concat_ws('|', {parts}))"


VC = "vc AS (SELECT cid, v, count(*) AS cnt FROM u GROUP BY cid, v)"
PROF = """prof AS (
    SELECT meta.*, p.* EXCLUDE (cid) FROM meta JOIN (
        SELECT cid, CAST(sum(cnt) AS BIGINT) AS row_count,
            CAST(coalesce(sum(cnt) FILTER (v IS NOT NULL), 0) AS BIGINT) AS non_null,
            count(v) AS distinct_values, count(*) AS groups,
            CAST(coalesce(sum(cnt) FILTER (v IS NULL OR v = ''), 0) AS BIGINT) AS blanks,
            CAST(coalesce(sum(cnt) FILTER (length(v) = strlen(v)), 0) AS BIGINT) AS ascii_rows,
            CAST(sum(cnt * coalesce(length(v), 4)) AS BIGINT) AS len_sum
        FROM vc GROUP BY cid) p ON p.cid = meta.cid)"""


def profile(cols, sampled=None) -> str:
    return f"WITH {meta(cols)}, {cells(cols, sampled)}, {VC}, {PROF}"


def counts(cols) -> str:
    """CTE counts: rows and non-NULL rows per column, straight from the tables."""
    parts = [
        f"SELECT {cid} AS cid, count(*) AS row_count, count({c}) AS non_null "
        f"FROM {frame_of(t)} x{cid}"
        for cid, t, c, _, _ in cols
    ]
    return f"WITH {meta(cols)}, counts AS ({' UNION ALL '.join(parts)})"


def row_counts(tables) -> str:
    return " UNION ALL ".join(
        f"SELECT {text(t)} AS table_name, count(*) AS row_count FROM {frame_of(t)} x"
        for t in tables
    )


UNIQUE = "non_null = row_count AND distinct_values = non_null"


def pk_condition(policy: str) -> str:
    if policy == "ascii":
        return f"({UNIQUE} AND (NOT is_text OR ascii_rows = distinct_values))"
    return f"({UNIQUE})"


def fk_condition(policy: str, both_roles: bool = True) -> str:
    pk = pk_condition(policy)
    key = pk if both_roles else "false"
    if policy == "any":
        return f"({key} OR NOT {pk})"
    if policy == "unique_only":
        return key
    return (
        f"({key} OR (is_text AND non_null = row_count AND ascii_rows = non_null "
        "AND distinct_values < non_null))"
    )


def name_matches(rule: str) -> str:
    if rule.endswith("%"):
        return f"column_name = {text(rule[:-1])}"
    return f"starts_with(column_name, {text(rule)})"


def name_condition(rules, mode="documented") -> str:
    if not rules:
        return "true"
    listed = rules.get("_", [])
    if mode == "compat" and listed:
        first = name_matches(listed[0])
        kept = [first if listed[0].endswith("%") else f"NOT {first}"]
    else:
        kept = [f"NOT {name_matches(rule)}" for rule in listed]
    for table, own in rules.items():
        if table != "_":
            kept += [f"NOT (table_name = {text(table)} AND {name_matches(r)})" for r in own]
    return "(" + " AND ".join(kept) + ")"


def type_condition(policy: str) -> str:
    allowed = TYPE_POLICIES[policy]
    if allowed is None:
        return "type_class <> 'other'"
    return "(type_class <> 'other' AND type_name IN (" + ", ".join(map(text, allowed)) + "))"


def relations(p, model: str | None = None) -> str:
    """SELECT with the 13 relation columns for the given parameters."""
    tables = p.tables or TABLES
    cols = [c for c in columns(TABLES) if c[1] in tables]
    sampled = p.sample_rows
    source_cells = cells(cols)
    barred_pk = "".join(f" AND table_name <> {text(t)}" for t in p.not_base_tables)
    barred_fk = "".join(f" AND table_name <> {text(t)}" for t in p.not_cite_tables)
    admitted = (
        f"row_count > 0 AND row_count >= {p.inf_tab_len} AND "
        f"{name_condition(p.name_rules, p.rules_mode)} AND {type_condition(p.type_policy)}"
    )
    value_gate = (
        f"groups >= row_count * {p.inf_dup_ratio}::DOUBLE "
        f"AND blanks / row_count <= {p.max_blank_ratio}::DOUBLE"
    )
    ctes = [meta(cols), source_cells, VC, PROF]
    if sampled:
        ctes += [
            cells(cols, sampled).replace("u AS", "us AS", 1),
            "vs AS (SELECT cid, v, count(*) AS cnt FROM us GROUP BY cid, v)",
            PROF.replace("prof AS", "tested AS", 1).replace("FROM vc", "FROM vs", 1),
        ]
    else:
        ctes += ["vs AS (SELECT * FROM vc)", "tested AS (SELECT * FROM prof)"]
    base = str(FIXED_RATIO_BASE) if p.ratio_base == "fixed" else "f.row_count"
    ctes += [
        f"pk AS (SELECT * FROM prof WHERE {admitted} AND {pk_condition(p.class_policy)}"
        f"{barred_pk})",
        f"fk AS (SELECT * FROM tested WHERE cid IN (SELECT cid FROM prof WHERE {admitted} AND "
        f"{fk_condition(p.class_policy, p.both_roles)}{barred_fk}) AND {value_gate})",
        "hits AS (SELECT a.cid AS fk, b.cid AS pk, sum(a.cnt) AS hits FROM vs a "
        "JOIN vc b ON a.v = b.v WHERE a.cid IN (SELECT cid FROM fk) "
        "AND b.cid IN (SELECT cid FROM pk) GROUP BY a.cid, b.cid)",
        f"scored AS (SELECT f.cid AS fk, p.cid AS pk, "
        f"CAST(f.row_count - coalesce(h.hits, 0) AS DOUBLE) / {base} AS miss_ratio "
        "FROM fk f JOIN pk p ON f.table_name <> p.table_name "
        "LEFT JOIN hits h ON h.fk = f.cid AND h.pk = p.cid)",
    ]
    name = text(model or p.model_id)
    ends = []
    for end, alias in (("1", "p"), ("2", "f")):
        ends.append(
            f"{name} AS model{end}, {text(DB)} AS db{end}, {alias}.table_name AS table{end}, "
            f"{alias}.table_comment AS table{end}comment, {alias}.column_name AS column{end}, "
            f"{alias}.column_comment AS column{end}comment"
        )
    return (
        f"WITH {', '.join(ctes)} SELECT {', '.join(ends)}, s.miss_ratio AS matching_degree "
        f"FROM scored s JOIN pk p ON p.cid = s.pk JOIN fk f ON f.cid = s.fk "
        f"WHERE s.miss_ratio <= {p.sup_out_foreign_key}::DOUBLE"
    )


KEY = "db1, table1, column1, db2, table2, column2"
MATCH = " AND ".join(f"a.{c} = b.{c}" for c in ("model", *KEY.split(", ")))
SHOWN = f"model, {KEY}, status, scantype, matching_degree"


def stored_form(params) -> str:
    return (
        f"SELECT md5(concat_ws('|', model1, {KEY})) AS id, model1 AS model, {KEY}, "
        f"1 AS status, 0 AS scantype, matching_degree FROM ({relations(params, MODEL)})"
    )


def results_sql() -> dict[str, str]:
    plain = RELATIONS["relations_any"]
    cur = f"WITH cur AS ({stored_form(plain)})"
    stored = (
        "stored AS (SELECT * FROM cur WHERE table1 < 'n' "
        "UNION ALL SELECT * REPLACE (1 AS scantype, 0 AS status) FROM cur "
        "WHERE table2 = 'nation' "
        "UNION ALL SELECT * REPLACE ('m2' AS model) FROM cur WHERE table2 = 'orders')"
    )
    marked = (
        "marked AS (SELECT a.* REPLACE (CASE WHEN EXISTS (SELECT 1 FROM {old} b "
        f"WHERE {MATCH}) THEN 0 ELSE 1 END AS status) FROM {{new}} a)"
    )
    old = "old AS (SELECT * FROM cur WHERE table1 < 'n')"
    return {
        "relation_status": f"{cur}, {old}, {marked.format(old='old', new='cur')} "
        f"SELECT {SHOWN} FROM marked",
        "relation_new": f"{cur}, {old} SELECT {SHOWN} FROM cur a "
        f"WHERE NOT EXISTS (SELECT 1 FROM old b WHERE {MATCH})",
        "relation_removed": f"{cur}, prev AS ("
        f"{stored_form(RELATIONS['relations_tolerant'])}) SELECT {SHOWN} FROM prev a "
        f"WHERE NOT EXISTS (SELECT 1 FROM cur b WHERE {MATCH})",
        "relation_history": history_sql(),
        "relation_replace": f"{cur}, {stored}, {marked.format(old='stored', new='cur')}, "
        f"kept AS (SELECT * FROM stored WHERE model <> '{MODEL}' OR scantype <> 0) "
        f"SELECT id, {SHOWN} FROM kept UNION ALL SELECT id, {SHOWN} FROM marked a "
        f"WHERE NOT EXISTS (SELECT 1 FROM kept b WHERE {MATCH})",
        "run_summary": f"{cur}, {stored}, both_models AS (SELECT * FROM cur UNION ALL "
        "SELECT * REPLACE ('m2' AS model) FROM cur), "
        f"{marked.format(old='stored', new='both_models')} SELECT model, "
        "count(*) AS relation_num, CAST(sum(status) AS BIGINT) AS new_relation_num "
        "FROM marked GROUP BY model",
    }


def history_sql() -> str:
    """Intervals by looking at each run and at its neighbours."""
    key = f"model, {KEY}"
    exact, tolerant = (
        f"({stored_form(RELATIONS[name])})" for name in ("relations_any", "relations_tolerant")
    )
    here = "EXISTS (SELECT 1 FROM seen b WHERE b.run = a.run {step} 1 AND " + MATCH + ")"
    return (
        f"WITH seen AS (SELECT {key}, 1 AS run FROM {exact} WHERE table1 < 'o' UNION ALL "
        f"SELECT {key}, 2 FROM {tolerant} WHERE table2 <> 'nation' UNION ALL "
        f"SELECT {key}, 3 FROM {exact}), "
        f"edges AS (SELECT *, NOT {here.format(step='-')} AS opens, "
        f"NOT {here.format(step='+')} AS closes FROM seen a), "
        f"o AS (SELECT {key}, run, row_number() OVER (PARTITION BY {key} ORDER BY run) AS i "
        f"FROM edges WHERE opens), "
        f"c AS (SELECT {key}, run, row_number() OVER (PARTITION BY {key} ORDER BY run) AS i "
        f"FROM edges WHERE closes) "
        f"SELECT {', '.join(f'o.{x}' for x in key.split(', '))}, o.run AS valid_from, "
        f"CASE WHEN c.run < 3 THEN c.run + 1 END AS valid_to FROM o JOIN c USING ({key}, i)"
    )


def resolve_params_sql() -> str:
    rules = ", ".join(f"'{r}'" for r in DEFAULT_NAME_RULES["_"])

    def numeric(source, name):
        return (
            f"CASE WHEN usable THEN coalesce({source}, {NULL_FIELD_DEFAULTS[name]}) "
            f"ELSE {NO_ROW_DEFAULTS[name]} END AS {name}"
        )

    return f"""
    WITH config AS (SELECT {CONFIG_COLUMNS} FROM customer WHERE c_acctbal > 0),
    joined AS (
        SELECT m.c_name AS model, c.csl, nullif(c.ds, '') AS ds, CAST(c.idr AS DOUBLE) AS idr,
            c.isl, c.itl, nullif(c.tables1, '') AS tables1,
            c.model IS NOT NULL AND (nullif(c.ds, '') IS NULL OR json_valid(c.ds)) AS usable
        FROM customer m LEFT JOIN config c ON c.model = concat(m.c_name, m.c_name))
    SELECT model, usable AS configured, usable AND coalesce(csl, '0') <> '0' AS use_str_len,
        {numeric('idr', 'inf_dup_ratio')}, {numeric('isl', 'inf_str_len')},
        {numeric('itl', 'inf_tab_len')},
        CASE WHEN usable AND ds IS NOT NULL
            THEN array_to_string(CAST(json_extract(ds, '$._') AS VARCHAR[]), ',')
            ELSE array_to_string([{rules}], ',') END AS global_rules,
        CASE WHEN usable AND ds IS NOT NULL
            THEN CAST(len(json_keys(ds)) AS BIGINT) ELSE 1 END AS rule_scopes,
        CASE WHEN usable THEN coalesce(tables1, '') ELSE '' END AS table_list
    FROM joined"""


def column_ranges_sql(cols) -> str:
    parts = []
    for cid, t, c, kind, _ in cols:
        ends = []
        for name in ("low", "high"):
            call = "min" if name == "low" else "max"
            whole = f"CAST({call}({c}) AS BIGINT)" if type_class(kind) == "integral" else "NULL::BIGINT"
            first = f"{call}(left({c}, 64))" if kind == "VARCHAR" else "NULL::VARCHAR"
            ends += [f"{whole} AS {name}_int", f"{first} AS {name}_text"]
        parts.append(
            f"SELECT {text(t)} AS table_name, {text(c)} AS column_name, count(*) AS row_count, "
            f"count({c}) AS non_null, {', '.join(ends)} FROM {frame_of(t)} x{cid}"
        )
    return " UNION ALL ".join(parts)


def profile_incremental_sql(plain) -> str:
    """Profile of the rows whose key isn't divisible by three."""
    thirds = {"orders": "o_orderkey", "events": "event_id"}
    cols = [c for c in plain if c[1] in thirds]
    parts = " UNION ALL ".join(
        f"SELECT {cid} AS cid, {cell_text(c, kind)} AS v FROM {t} WHERE {thirds[t]} % 3 <> 0"
        for cid, t, c, kind, _ in cols
    )
    return (
        f"WITH {meta(cols)}, u AS ({parts}), {VC}, {PROF} SELECT table_name, column_name, row_count, "
        f"non_null, distinct_values, groups, blanks, ascii_rows, {UNIQUE} AS is_unique FROM prof"
    )


def kept_sql(condition: str) -> str:
    return (
        f"{counts(columns(TABLES, other=True))} SELECT table_name, column_name, "
        f"{condition} AS kept, CASE WHEN {condition} THEN non_null END AS non_null "
        "FROM meta JOIN counts USING (cid)"
    )


def oracle_sql() -> dict[str, str]:
    every, plain = columns(TABLES, other=True), columns(TABLES)
    both, lineitem = columns(BOTH), [c for c in plain if c[1] == "lineitem"]
    tables = ", ".join(f"({text(t)}, {text(TABLE_COMMENTS.get(t, ''))})" for t in TABLES)
    listed = f"t(table_name, table_comment) AS (VALUES {tables})"
    cand = f"{profile(plain)} SELECT table_name, column_name, row_count, distinct_values FROM prof"
    return {
        "catalog_tables": f"WITH {listed} SELECT table_name, {text(DB)} AS db, table_comment, "
        f"row_count FROM t JOIN ({row_counts(TABLES)}) USING (table_name)",
        "catalog_subset": f"WITH {listed}, r(table_name) AS (VALUES ('orders'), ('lineitem'), "
        "('labels'), ('no_such_table')) SELECT r.table_name, t.table_name IS NOT NULL AS found, "
        "coalesce(table_comment, '') AS table_comment, row_count FROM r "
        "LEFT JOIN t ON t.table_name = r.table_name LEFT JOIN "
        f"({row_counts(TABLES)}) c ON c.table_name = r.table_name",
        "catalog_columns": f"{counts(every)} SELECT {text(DB)} AS db, table_name, column_name, "
        "type_name, type_class, is_text, column_comment, CAST(ordinal AS INTEGER) AS ordinal, "
        "non_null FROM meta JOIN counts USING (cid)",
        "catalog_commented_columns": f"{counts(every)} SELECT table_name, column_name, "
        "CASE WHEN is_text THEN concat('texte écrit: ', non_null) ELSE '' END AS column_comment "
        "FROM meta JOIN counts USING (cid)",
        "ddl_comment": "SELECT doc_id, trim(regexp_extract(concat('CREATE TABLE d', doc_id, "
        "' (', chr(10), ' id bigint', chr(10), ')', CASE WHEN lang = 'en' THEN '' "
        "ELSE concat(' COMMENT ', source, ' in ', lang) END, chr(10), 'TBLPROPERTIES (', text, "
        "')'), '\\)\\sCOMMENT(.*)\\s', 1)) AS table_comment FROM documents",
        "resolve_params": resolve_params_sql(),
        "table_gate": "SELECT table_name, row_count, CASE WHEN row_count > 50000 THEN 'too_long' "
        "WHEN row_count = 0 THEN 'empty' WHEN row_count < 30 THEN 'too_short' ELSE 'ok' END "
        f"AS reason FROM ({row_counts(TABLES)})",
        "column_name_gate": kept_sql(name_condition(NAME_RULES)),
        "column_name_gate_by_table": kept_sql(name_condition(TABLE_RULES)),
        "column_name_gate_compat": kept_sql(name_condition(NAME_RULES, "compat")),
        "column_type_gate": kept_sql(type_condition("mysql")),
        "column_type_gate_oracle": kept_sql(type_condition("oracle")),
        "complete_columns": f"{counts(columns(BOTH, other=True))} SELECT table_name, column_name, "
        "row_count, non_null FROM meta JOIN counts USING (cid) WHERE non_null = row_count",
        "gate_avg_len": f"{profile(both)} SELECT table_name, column_name, row_count, "
        "len_sum, len_sum / row_count < 6 AS rejected FROM prof",
        "gate_distinct_ratio": f"{profile(both)} SELECT table_name, column_name, row_count, "
        "groups, groups < row_count * 0.3::DOUBLE AS rejected FROM prof",
        "gate_blank_ratio": f"{profile(both)} SELECT table_name, column_name, row_count, blanks, "
        "blanks / row_count > 0.8::DOUBLE AS rejected FROM prof",
        "value_gate": f"{profile(both)} SELECT table_name, column_name, CASE "
        "WHEN len_sum / row_count < 3 THEN 'avg_len' "
        "WHEN groups < row_count * 0.001::DOUBLE THEN 'distinct_ratio' "
        "WHEN blanks / row_count > 0.8::DOUBLE THEN 'blank_ratio' END AS reject_reason FROM prof",
        "table_row_counts": row_counts(BOTH),
        "column_non_null": f"{counts(columns(BOTH, other=True))} SELECT table_name, column_name, "
        "row_count, non_null FROM meta JOIN counts USING (cid)",
        "column_distinct": f"{profile(both)} SELECT table_name, column_name, distinct_values "
        "FROM prof",
        "column_ascii": f"{profile(both)} SELECT table_name, column_name, non_null, ascii_rows "
        "FROM prof WHERE is_text",
        "column_profile": f"{profile(plain)} SELECT table_name, column_name, row_count, non_null, "
        f"distinct_values, groups, blanks, ascii_rows, {UNIQUE} AS is_unique FROM prof",
        "pk_values": f"{profile(plain)} SELECT table_name, column_name, "
        f"v FROM vc JOIN prof USING (cid) WHERE {UNIQUE}",
        "keys_kept": f"{profile(plain)} SELECT table_name AS pk_table, column_name AS pk_column, "
        f"v FROM vc JOIN prof USING (cid) WHERE {UNIQUE}",
        "values_long": f"WITH {meta(both)}, {cells(both)} SELECT table_name, column_name, "
        "count(*) AS cells, count(v) AS present FROM u JOIN meta USING (cid) "
        "GROUP BY table_name, column_name",
        "column_sample": "SELECT * REPLACE (CAST(l_shipdate AS VARCHAR) AS l_shipdate) FROM "
        f"{sample_of('lineitem', lineitem, 10_000)}",
        "profile_incremental": profile_incremental_sql(plain),
        "footer_ranges": "SELECT table_name, column_name, row_count, non_null, low_int, high_int "
        f"FROM ({column_ranges_sql(both)})",
        "column_ranges": column_ranges_sql(both),
        "pk_screened": f"{cand} WHERE {pk_condition('any')}",
        "inclusion_nested": f"SELECT CAST(f AS INTEGER) AS fk, CAST(p AS INTEGER) AS pk, "
        f"CAST(sum(n) AS BIGINT) AS hits FROM (SELECT o_orderkey % {NESTED} AS least, "
        f"count(*) AS n FROM orders GROUP BY 1), range({NESTED}) f(f), range({NESTED}) p(p) "
        "WHERE least <= f AND least <= p GROUP BY ALL",
        "pk_candidates": f"{cand} WHERE {pk_condition('any')}",
        "pk_candidates_ascii": f"{cand} WHERE {pk_condition('ascii')}",
        "fk_candidates_unique": f"{cand} WHERE {fk_condition('unique_only')}",
        "fk_candidates_ascii": f"{cand} WHERE {fk_condition('ascii')}",
        "fk_candidates_any": f"{cand} WHERE {fk_condition('any')}",
        "fk_candidates_single_role": f"{cand} WHERE {fk_condition('any', False)}",
        "candidate_pairs": f"{profile(plain)} SELECT f.table_name AS fk_table, "
        "f.column_name AS fk_column, p.table_name AS pk_table, p.column_name AS pk_column "
        "FROM prof f JOIN (SELECT * FROM prof WHERE " + UNIQUE + ") p "
        "ON f.table_name <> p.table_name",
        "inclusion_misses": f"{profile(plain)}, hits AS (SELECT a.cid AS fk, b.cid AS pk, "
        "CAST(sum(a.cnt) AS BIGINT) AS hits FROM vc a JOIN vc b ON a.v = b.v "
        f"JOIN (SELECT cid FROM prof WHERE {UNIQUE}) k ON k.cid = b.cid GROUP BY a.cid, b.cid) "
        "SELECT f.table_name AS fk_table, f.column_name AS fk_column, p.table_name AS pk_table, "
        "p.column_name AS pk_column, f.row_count, hits, f.row_count - hits AS misses, "
        "(f.row_count - hits) / f.row_count AS miss_ratio FROM hits "
        "JOIN prof f ON f.cid = hits.fk JOIN prof p ON p.cid = hits.pk "
        "WHERE f.table_name <> p.table_name",
        "inclusion_rounds": f"{profile(plain)}, hits AS (SELECT a.cid AS fk, b.cid AS pk, "
        "CAST(sum(a.cnt) AS BIGINT) AS hits FROM vc a JOIN vc b ON a.v = b.v "
        f"JOIN (SELECT cid FROM prof WHERE {UNIQUE}) k ON k.cid = b.cid GROUP BY a.cid, b.cid) "
        "SELECT f.table_name AS fk_table, f.column_name AS fk_column, p.table_name AS pk_table, "
        "p.column_name AS pk_column, f.row_count, hits, f.row_count - hits AS misses, "
        "(f.row_count - hits) / f.row_count AS miss_ratio FROM hits "
        "JOIN prof f ON f.cid = hits.fk JOIN prof p ON p.cid = hits.pk "
        f"WHERE f.table_name <> p.table_name AND (f.row_count - hits) / f.row_count "
        f"<= {INCLUSION_TOLERANCE}::DOUBLE",
        "orphan_rows": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS "
        "(SELECT 1 FROM supplier WHERE s_suppkey = o_custkey)",
        "matched_rows": "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS "
        "(SELECT 1 FROM supplier WHERE s_suppkey = o_custkey)",
        **{name: relations(params) for name, params in RELATIONS.items()},
        **{f"{name}_staged": relations(RELATIONS[name]) for name in STAGED},
        "relations_many_models": " UNION ALL ".join(
            f"SELECT * FROM ({relations(p, name)})" for name, p in MANY_MODELS.items()
        ),
        **results_sql(),
    }
