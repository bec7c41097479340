"""SQL type names: normal forms, and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Names that mean the same type (fixed values), compared in upper case without spaces and underscores.
ALIASES = {
    "INTEGER": ("INT", "INTEGER", "INT4", "SIGNED"),
    "BIGINT": ("BIGINT", "INT8", "LONG"),
    "SMALLINT": ("SMALLINT", "INT2", "SHORT"),
    "TINYINT": ("TINYINT",),
    "DOUBLE": ("DOUBLE", "FLOAT8", "DOUBLEPRECISION"),
    "FLOAT": ("FLOAT", "REAL", "FLOAT4"),
    "DECIMAL": ("DECIMAL", "NUMERIC"),
    "BOOLEAN": ("BOOLEAN", "BOOL"),
    "VARCHAR": ("VARCHAR", "CHAR", "CHARACTER", "STRING", "TEXT"),
    "DATE": ("DATE",),
    "TIMESTAMP": ("TIMESTAMP", "DATETIME", "TIMESTAMPWITHOUTTIMEZONE"),
    "TIMESTAMPTZ": ("TIMESTAMPWITHTIMEZONE", "TIMESTAMPTZ"),
}
_NORMAL = {a: n for n, names in ALIASES.items() for a in names}
_SPARK: dict[str, T.DataType] = {
    "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "SMALLINT": T.ShortType(), "TINYINT": T.ByteType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(),
    "DECIMAL": T.DecimalType(18, 3), "BOOLEAN": T.BooleanType(), "VARCHAR": T.StringType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMPTZ": T.TimestampType(),
    "TIMESTAMPNS": T.TimestampNTZType(), "TIMESTAMPS": T.TimestampNTZType(), "TIMESTAMPMS": T.TimestampNTZType(), "HUGEINT": T.DecimalType(38, 0), "UUID": T.StringType(), "TIME": T.StringType(), "BLOB": T.BinaryType(), "INTERVAL": T.DayTimeIntervalType(),
}
_NAMES = {T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.ShortType: "SMALLINT", T.ByteType: "TINYINT", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.BooleanType: "BOOLEAN", T.StringType: "VARCHAR", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMPTZ", T.BinaryType: "BLOB", T.DayTimeIntervalType: "INTERVAL"}
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = (*INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)


def normalize(name: str) -> str:
    """The canonical name of an alias; other names in upper case without spaces and underscores."""
    bare = re.sub(r"[ _]", "", name.strip().upper())
    return _NORMAL.get(bare, bare)


def parse(name: str) -> T.DataType:
    """The Spark type of a SQL type name; T[] is an array. Unknown names are errors."""
    text = name.strip()
    if text.endswith("[]"):
        return T.ArrayType(parse(text[:-2]))
    normal = normalize(text)
    if normal in _SPARK:
        return _SPARK[normal]
    if m := re.fullmatch(r"(?:DECIMAL|NUMERIC)\((\d+)(?:,(\d+))?\)", normal):
        return T.DecimalType(int(m[1]), int(m[2] or 0))
    if re.fullmatch(r"(?:VARCHAR|CHAR|CHARACTER)\(\d+\)", normal):
        return T.StringType()
    try:
        return T._parse_datatype_string(text)
    except Exception as e:
        raise ValueError(f"unknown type {name!r}") from e


def name_of(kind: T.DataType) -> str:
    """The SQL type name of a Spark type."""
    if isinstance(kind, T.ArrayType):
        return name_of(kind.elementType) + "[]"
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    return _NAMES.get(type(kind), kind.simpleString().upper())
