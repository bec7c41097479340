"""Operators that choose or order rows: Filter, Sort, Limit, Deduplicate, MergeUnion, Conditional, Switch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.expressions import predicate, quoted, sort_key
from millrace.plans.relation import Relation

from .base import chosen, distinct, listed, operator, required


@operator("Filter")
def filter_rows(inputs: list[Relation], config: dict) -> Relation:
    """Rows for which all (or any) rules hold; a rule that is null doesn't hold."""
    rules = listed(config.get("rules"), "rule")
    return inputs[0].filtered(predicate(inputs[0], rules, chosen(config.get("mode"), ("all", "any"), "all", "mode")))


def _keys(relation: Relation, keys: list[dict]) -> list[tuple[str, str, str]]:
    out = [(relation.resolve(required(k.get("column"), "sort key column")).name, chosen(k.get("direction"), ("asc", "desc"), "asc", "direction"), chosen(k.get("nulls"), ("first", "last", ""), "", "nulls")) for k in keys]
    distinct([k[0] for k in out], "sort key")
    return out


@operator("Sort")
def sort(inputs: list[Relation], config: dict) -> Relation:
    """Total order by keys; nulls come last in either direction unless said otherwise."""
    keys = _keys(inputs[0], listed(config.get("keys"), "sort key"))
    return Relation(inputs[0].df.orderBy(*(sort_key(quoted(n), d, u) for n, d, u in keys)), inputs[0].columns)


@operator("Limit", "LimitSample")
def limit(inputs: list[Relation], config: dict) -> Relation:
    """`count` rows after `offset`, of the order of a sort before it (else of any)."""
    count, offset = config.get("count") or 0, config.get("offset") or 0
    if count <= 0:
        raise ValueError("count must be greater than zero")
    if offset < 0:
        raise ValueError("offset must be >= 0")
    df = inputs[0].df.offset(offset) if offset else inputs[0].df
    return Relation(df.limit(count), inputs[0].columns)


@operator("Deduplicate")
def deduplicate(inputs: list[Relation], config: dict) -> Relation:
    """The first (or last) row of each key by order_by; null keys are a group. `last` turns directions and stated null orders round."""
    base = inputs[0]
    names = [base.resolve(c).name for c in listed(config.get("columns"), "deduplicate column")]
    distinct(names, "deduplicate column")
    last = chosen(config.get("keep"), ("first", "last"), "first", "keep") == "last"
    keys = [k for k in _keys(base, listed(config.get("order_by"), "order_by key")) if k[0] not in names]
    other = {"asc": "desc", "desc": "asc", "first": "last", "last": "first", "": ""}
    order = [sort_key(quoted(n), other[d] if last else d, other[u] if last else u) for n, d, u in keys] or [F.lit(1)]
    place = "__place"
    ranked = base.df.withColumn(place, F.row_number().over(Window.partitionBy(*map(quoted, names)).orderBy(*order)))
    return Relation(ranked.filter(F.col(place) == 1).drop(place), base.columns)


@operator("MergeUnion")
def union(inputs: list[Relation], config: dict) -> Relation:
    """All rows of all inputs, whose columns must match the first's: by place, or by name in any order. Type names are compared as texts."""
    if len(inputs) < 2:
        raise ValueError("at least two inputs are required")
    mode = chosen(config.get("mode"), ("strict_positional", "align_by_name"), "strict_positional", "mode")
    base = inputs[0]
    frames = [base.df]
    for k, other in enumerate(inputs[1:], 1):
        if len(other.columns) != len(base.columns):
            raise ValueError(f"input {k}: column count mismatch")
        if mode == "strict_positional":
            pairs = list(zip(base.columns, other.columns, strict=True))
            if bad := next((b.name for a, b in pairs if a.name.lower() != b.name.lower()), None):
                raise ValueError(f"input {k}: name mismatch at {bad!r}")
        else:
            if missing := [c.name for c in base.columns if other.find(c.name) is None]:
                raise ValueError(f"input {k}: missing columns: {', '.join(missing)}")
            pairs = [(c, other.resolve(c.name)) for c in base.columns]
        if bad := next((b.name for a, b in pairs if a.sql_type.strip().lower() != b.sql_type.strip().lower()), None):
            raise ValueError(f"input {k}: type mismatch at {bad!r}")
        frames.append(other.df.select(*(quoted(b.name) for _, b in pairs)))
    return Relation(reduce(lambda a, b: a.union(b), frames), base.columns)


@operator("Conditional")
def conditional(inputs: list[Relation], config: dict) -> dict[str, Relation]:
    """`if`: rows for which the rules hold; `else`: rows for which they don't. Rows for which they are null are in neither."""
    p = predicate(inputs[0], config.get("rules") or [], chosen(config.get("mode"), ("all", "any"), "all", "mode"))
    return {"if": inputs[0].filtered(p), "else": inputs[0].filtered(~p)}


@operator("Switch")
def switch(inputs: list[Relation], config: dict) -> dict[str, Relation]:
    """A branch for each label, independent of the others, and `default` for rows for which no branch's rules hold. A branch without rules takes all rows."""
    branches = listed(config.get("branches"), "branch")
    labels = [required(b.get("label"), "branch label").strip() for b in branches]
    distinct(labels, "branch label")
    if any(label.lower() == "default" for label in labels):
        raise ValueError("branch label default is reserved")
    held = [predicate(inputs[0], b.get("rules") or [], chosen(b.get("mode"), ("all", "any"), "all", "mode")) for b in branches]
    out = {label.lower(): inputs[0].filtered(p) for label, p in zip(labels, held, strict=True)}
    return out | {"default": inputs[0].filtered(~reduce(lambda a, b: a | b, held))}
