"""Value identity.

Two cells hold the same value when their canonical text is equal, whatever the
declared types: ``INT 5``, ``BIGINT 5``, ``DECIMAL 5.00`` and ``'5'`` are one
value.  Counting does not need the text, though.  Values are grouped in their
native type first (``native_value``) and only the distinct ones are rendered,
so a column with a billion rows and ten values pays for ten casts.

The builders return SQL text: catalogs with thousands of columns then cost one
parsed projection per table instead of many calls per column.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Texts longer than this are grouped and joined by a digest of the whole text.
# A digest key is longer than the limit, so it never equals a short text.
MAX_KEY_BYTES = 64
DIGEST_PREFIX = "#"

INTEGRAL, FLOATING, TEXT = "integral", "floating", "text"


def family(dtype: T.DataType) -> str | None:
    """Grouping family of a type; ``None`` for types that never hold keys."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGRAL
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return FLOATING
    if isinstance(dtype, T.DecimalType):
        return dtype.simpleString()
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return dtype.typeName()
    if is_text(dtype) or isinstance(dtype, T.BooleanType):
        return TEXT
    return None


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def declared_name(dtype: T.DataType) -> str:
    """Upper-case SQL name of a Spark type, without its arguments."""
    if isinstance(dtype, T.CharType):
        return "CHAR"
    if isinstance(dtype, (T.StringType, T.VarcharType)):
        return "VARCHAR"
    return dtype.simpleString().split("(")[0].split("<")[0].upper()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def native_value(name: str, dtype: T.DataType) -> str:
    """The form in which values of a family are grouped."""
    kind = family(dtype)
    if kind == INTEGRAL:
        return f"CAST({quoted(name)} AS BIGINT)"
    if kind == FLOATING:
        # Adding zero folds -0.0 into 0.0.
        return f"CAST({quoted(name)} AS DOUBLE) + 0.0D"
    if kind == TEXT:
        text = f"CAST({quoted(name)} AS STRING)"
        if not is_text(dtype):
            return text
        return (
            f"CASE WHEN octet_length({text}) > {MAX_KEY_BYTES} "
            f"THEN concat('{DIGEST_PREFIX}', sha2({text}, 256)) ELSE {text} END"
        )
    return quoted(name)


def rendered(native: str, kind: str) -> str:
    """Canonical text of a grouped value."""
    scale = re.fullmatch(r"decimal\(\d+,(\d+)\)", kind)
    if scale and int(scale[1]) > 0:
        # Plain digits whatever the cast rules of the session; dropping the
        # zeros in text keeps all digits of wide decimals.
        plain = f"replace(format_number({native}, {scale[1]}), ',', '')"
        return rf"regexp_replace(regexp_replace({plain}, r'0+$', ''), r'\.$', '')"
    return f"CAST({native} AS STRING)"


def join_key(name: str, dtype: T.DataType) -> str:
    """Row-level join key; equal for two cells iff they hold the same value."""
    return rendered(native_value(name, dtype), family(dtype))


def canonical_text(name: str, dtype: T.DataType) -> str:
    """Row-level canonical text, whole."""
    if family(dtype) == TEXT:
        return f"CAST({quoted(name)} AS STRING)"
    return join_key(name, dtype)
