"""The test tables as both engines see them."""

from __future__ import annotations

DB = "testdata"

# Tables and columns of the test data, with their declared types.
COLUMNS = {
    "region": "r_regionkey INT, r_name VARCHAR",
    "nation": "n_nationkey INT, n_name VARCHAR, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment VARCHAR",
    "supplier": "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INT, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority VARCHAR",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type VARCHAR, "
    "value DOUBLE, props VARCHAR",
    "documents": "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY, label INT",
    "pages": "page_id BIGINT, url VARCHAR, html VARCHAR",
    "benchmark": "item_id BIGINT, text VARCHAR",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR",
}
TABLES = tuple(COLUMNS)

TABLE_COMMENTS = {
    "region": "regions of the world",
    "nation": "nations and the region they belong to",
    "orders": "orders placed by customers",
    "lineitem": "lines of an order",
}
COLUMN_COMMENTS = {
    ("region", "r_regionkey"): "region id",
    ("nation", "n_nationkey"): "nation id",
    ("nation", "n_regionkey"): "region the nation lies in",
    ("lineitem", "l_orderkey"): "order the line belongs to",
}

# Tables with NULLs and blanks, cut from the test tables by expressions that
# read the same in both engines: name -> (base table, {column: (expression, type)}).
OPTIONAL = {
    "orders_opt": (
        "orders",
        {
            "o_orderkey": ("o_orderkey", "BIGINT"),
            "open_priority": (
                "CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END", "VARCHAR"),
            "urgent_customer": (
                "CASE WHEN o_orderpriority LIKE '1%' THEN o_custkey END", "BIGINT"),
            "urgent_flag": (
                "CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE '' END", "VARCHAR"),
        },
    ),
    "events_opt": (
        "events",
        {
            "event_id": ("event_id", "BIGINT"),
            "click_props": ("CASE WHEN event_type = 'click' THEN props END", "VARCHAR"),
            "rare_note": ("CASE WHEN value > 300 THEN event_type ELSE '' END", "VARCHAR"),
            "event_type": ("event_type", "VARCHAR"),
        },
    ),
    "documents_opt": (
        "documents",
        {
            "doc_id": ("doc_id", "BIGINT"),
            "foreign_text": ("CASE WHEN lang <> 'en' THEN text END", "VARCHAR"),
            "foreign_lang": ("CASE WHEN lang = 'en' THEN '' ELSE lang END", "VARCHAR"),
        },
    ),
}

_CLASSES = {
    "INT": "integral", "BIGINT": "integral", "DOUBLE": "floating", "VARCHAR": "text",
    "TIMESTAMP_NTZ": "timestamp_ntz", "ARRAY": "other",
}


def type_class(type_name: str) -> str:
    return _CLASSES[type_name]


def columns_of(table: str) -> list[tuple[str, str]]:
    """(column, declared type) of a test table or an optional table."""
    if table in OPTIONAL:
        return [(name, kind) for name, (_, kind) in OPTIONAL[table][1].items()]
    return [tuple(item.strip().split(" ")) for item in COLUMNS[table].split(",")]
