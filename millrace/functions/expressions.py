"""Columns with the semantics of plans: literals, assignment casts, predicates, templates, sort keys."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import types

#: The value that no text has, so that LIKE has no escape character.
NO_ESCAPE = "\x00"
OPERATIONS = ("eq", "ne", "contains", "startsWith", "endsWith", "gt", "lt")
_LIKE = {"contains": "%{}%", "startsWith": "{}%", "endsWith": "%{}"}
TEMPLATE = re.compile(r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def literal(value: Any) -> Column:
    """A JSON value as a literal; arrays and objects are errors."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return F.lit(value)
    raise ValueError(f"unsupported value type {type(value).__name__}")


@F.pandas_udf(T.StringType())
def _number_text(numbers: pd.Series) -> pd.Series:
    return pd.Series([None if x != x else str(x) for x in numbers.to_numpy()], dtype=object)


def to_text(col: Column, kind: T.DataType) -> Column:
    """Text as SQL casts give it. Doubles and floats are written with the fewest digits that give them back."""
    if isinstance(kind, T.StringType):
        return col
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(col), F.lit("nan")).otherwise(_number_text(col))
    return col.cast("string")


def assign_cast(col: Column, kind: T.DataType, to: T.DataType) -> Column:
    """A value assigned to a column of type `to`: fractions round (binary ones half to even, others half up), what doesn't fit is an error."""
    if kind == to:
        return col
    if isinstance(to, types.INTEGRAL):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.rint(col).cast(to)
        if isinstance(kind, T.DecimalType):
            return F.round(col, 0).cast(to)
        if isinstance(kind, T.StringType):
            return F.round(F.trim(col).cast("decimal(38,10)"), 0).cast(to)
    if isinstance(to, T.StringType):
        return to_text(col, kind)
    if isinstance(to, T.ArrayType) and isinstance(kind, T.StringType):
        return _array_of(col, to)
    return col.cast(to)


def _array_of(col: Column, to: T.ArrayType) -> Column:
    """Text such as [1, 2], ['a', b] or [] as an array; elements NULL are null; other text is an error."""
    inside = F.trim(F.regexp_extract(col, r"^\s*\[([\s\S]*)\]\s*$", 1))
    bad = ~F.rlike(col, F.lit(r"^\s*\[[\s\S]*\]\s*$"))
    item = r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^,\[\]]*?)\s*(?:,|$)"""
    found = F.regexp_extract_all(inside, F.lit(item), F.lit(1))
    # The pattern also matches at the end of the text.
    items = F.when(inside == "", F.array().cast("array<string>")).otherwise(F.slice(found, F.lit(1), F.greatest(F.size(found) - F.when(F.rlike(inside, F.lit(r",\s*$")), 0).otherwise(1), F.lit(0))))
    plain = F.transform(items, lambda x: F.when(F.upper(x) == "NULL", None).when(x.rlike(r"""^["']"""), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))
    cast = F.transform(plain, lambda x: assign_cast(x, T.StringType(), to.elementType))
    return F.when(col.isNull(), None).when(bad, F.raise_error(F.concat(F.lit("malformed array text: "), col)).cast(to)).otherwise(cast.cast(to))


def rule(col: Column, kind: T.DataType, operation: str, value: Any) -> Column:
    """One condition. LIKE operations leave % and _ of the value as wildcards; no escape character."""
    if operation in _LIKE:
        if not isinstance(value, str):
            raise ValueError(f"operation {operation} requires a string value")
        if not isinstance(kind, T.StringType):
            raise ValueError(f"operation {operation} requires a text column")
        return F.like(col, F.lit(_LIKE[operation].format(value)), F.lit(NO_ESCAPE))
    if operation in ("gt", "lt") and isinstance(kind, T.StringType) and isinstance(value, (int, float)) and not isinstance(value, bool):
        raise ValueError(f"operation {operation} can't compare text with a number")
    other = literal(value)
    match operation:
        case "eq":
            return col == other
        case "ne":
            return col != other
        case "gt":
            return col > other
        case "lt":
            return col < other
    raise ValueError(f"unsupported operation {operation!r}")


def predicate(relation, rules: list[dict], mode: str) -> Column:
    """All or any of the rules; without rules, true."""
    conditions = []
    for r in rules:
        c = relation.resolve(r.get("column") or "")
        conditions.append(rule(quoted(c.name), relation.kind(c.name), r.get("operation") or "", r.get("value")))
    if not conditions:
        return F.lit(True)
    return reduce((lambda a, b: a | b) if mode == "any" else (lambda a, b: a & b), conditions)


def template(relation, text: str) -> Column:
    """Text with {{column}} parts. A single part alone is the column itself; nulls in a longer text count as empty."""
    found = list(TEMPLATE.finditer(text))
    if not found:
        raise ValueError(f"template {text!r} has no valid token")
    if len(found) == 1 and found[0].span() == (0, len(text.strip())) and text == text.strip():
        return quoted(relation.resolve(found[0][1]).name)
    parts, at = [], 0
    for m in found:
        if m.start() > at:
            parts.append(F.lit(text[at : m.start()]))
        c = relation.resolve(m[1])
        parts.append(F.coalesce(to_text(quoted(c.name), relation.kind(c.name)), F.lit("")))
        at = m.end()
    if at < len(text):
        parts.append(F.lit(text[at:]))
    return F.concat(*parts)


def sort_key(col: Column, direction: str, nulls: str) -> Column:
    """Nulls are last in both directions unless said otherwise."""
    if direction == "desc":
        return col.desc_nulls_first() if nulls == "first" else col.desc_nulls_last()
    return col.asc_nulls_first() if nulls == "first" else col.asc_nulls_last()
