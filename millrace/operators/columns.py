"""Operators on columns: SelectColumns, ConstantColumn, ComputeColumn, RenameColumns, CastColumns, FillReplace, and schema changes as a library call."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from millrace.functions import dialect, types
from millrace.functions.expressions import literal, quoted, template
from millrace.plans.relation import Column, Relation

from .base import distinct, listed, operator, required


def _declared(relation: Relation, spec: dict | None) -> Column:
    """A new column of a configuration; its name must be free."""
    spec = spec or {}
    name = required(spec.get("name"), "column name")
    if relation.find(name):
        raise ValueError(f"column {name!r} already exists")
    return Column(name, required(spec.get("sql_type"), "column sql_type"))


@operator("SelectColumns")
def select(inputs: list[Relation], config: dict) -> Relation:
    base = inputs[0]
    names = listed(config.get("columns"), "column")
    if bad := [n for n in names if base.find(n) is None]:
        raise ValueError(f"invalid columns selected: {', '.join(bad)}")
    distinct(names, "column")
    found = [base.resolve(n) for n in names]
    return Relation(base.df.select(*(quoted(c.name) for c in found)), tuple(found))


@operator("ConstantColumn")
def constant(inputs: list[Relation], config: dict) -> Relation:
    base = inputs[0]
    new = _declared(base, config.get("column"))
    return base.project([*base.own(), (new, literal(config.get("value")), None)])


@operator("ComputeColumn")
def compute(inputs: list[Relation], config: dict) -> Relation:
    """New columns from templates or SQL expressions over the input's columns; those of the same node can't refer to each other."""
    base = inputs[0]
    specs = listed(config.get("columns"), "compute column")
    distinct([s.get("name") or "" for s in specs], "column")
    outputs = base.own()
    for spec in specs:
        new = _declared(base, spec)
        text = required(spec.get("expr"), "compute expression")
        if "{{" in text or "}}" in text:
            value = template(base, text)
        else:
            value = F.expr(dialect.to_spark(text))
            try:
                base.df.select(value)
            except AnalysisException as e:
                raise ValueError(f"expression {text!r}: {str(e).splitlines()[0]}") from e
        outputs.append((new, value, None))
    return base.project(outputs)


@operator("RenameColumns")
def rename(inputs: list[Relation], config: dict) -> Relation:
    """All renames at once, so names can be exchanged."""
    base = inputs[0]
    renames = listed(config.get("renames"), "rename")
    to: dict[str, str] = {}
    for r in renames:
        source, target = base.resolve(required(r.get("from"), "rename from")).name, required(r.get("to"), "rename to")
        if source.lower() == target.strip().lower():
            raise ValueError(f"rename of {source!r} is a no-op")
        if source in to:
            raise ValueError(f"duplicate rename source {source!r}")
        to[source] = target
    distinct(list(to.values()), "rename target")
    distinct([to.get(n, n) for n in base.names], "column")
    columns = tuple(Column(to.get(c.name, c.name), c.sql_type) for c in base.columns)
    return Relation(base.df.select(*(quoted(a.name).alias(b.name) for a, b in zip(base.columns, columns, strict=True))), columns)


@operator("CastColumns")
def cast(inputs: list[Relation], config: dict) -> Relation:
    """Strict casts: a value that doesn't fit fails the run."""
    base = inputs[0]
    casts: dict[str, str] = {}
    for c in listed(config.get("casts"), "cast"):
        found, to = base.resolve(required(c.get("column"), "cast column")), required(c.get("sql_type"), "cast sql_type")
        if found.name in casts:
            raise ValueError(f"duplicate cast of {found.name!r}")
        if found.sql_type.strip().lower() == to.strip().lower():
            raise ValueError(f"cast of {found.name!r} to {to} is a no-op")
        casts[found.name] = to
    return base.project([(Column(c.name, casts.get(c.name, c.sql_type)), v, kind) for c, v, kind in base.own()])


@operator("FillReplace")
def fill_replace(inputs: list[Relation], config: dict) -> Relation:
    """Replaces one value by another, then fills nulls; the result has the column's type."""
    base = inputs[0]
    rules: dict[str, dict] = {}
    for r in listed(config.get("rules"), "fill/replace rule"):
        name = base.resolve(required(r.get("column"), "rule column")).name
        fill, old, new = (r.get(k) for k in ("fill_null_with", "replace_from", "replace_to"))
        if name in rules:
            raise ValueError(f"duplicate rule for {name!r}")
        if (old is None) != (new is None):
            raise ValueError("replace_from and replace_to must be given together")
        if fill is None and old is None:
            raise ValueError(f"rule for {name!r} neither fills nor replaces")
        rules[name] = r
    outputs = []
    for c, v, kind in base.own():
        r = rules.get(c.name)
        if r:
            if r.get("replace_from") is not None:
                v = F.when(v == literal(r["replace_from"]), literal(r["replace_to"])).otherwise(v)
            if r.get("fill_null_with") is not None:
                v = F.coalesce(v, literal(r["fill_null_with"]))
        outputs.append((c, v, None if r else kind))
    return base.project(outputs)


def change_schema(relation: Relation, operations: list[dict]) -> Relation:
    """add_column (name, sql_type, value), drop_column, rename_column (name, to) and change_type (name, sql_type) in turn. Names must match in case."""
    now: list[tuple[Column, object, object]] = list(relation.own())

    def at(name: str) -> int:
        k = next((k for k, (c, _, _) in enumerate(now) if c.name == name), None)
        if k is None:
            raise ValueError(f"column {name!r} not found")
        return k

    for op in operations:
        kind, name = op.get("op"), required(op.get("name"), "column name")
        match kind:
            case "add_column":
                if any(c.name == name for c, _, _ in now):
                    raise ValueError(f"column {name!r} already exists")
                now.append((Column(name, required(op.get("sql_type"), "sql_type")), literal(op.get("value")), None))
            case "drop_column":
                del now[at(name)]
            case "rename_column":
                k = at(name)
                now[k] = (Column(required(op.get("to"), "new name"), now[k][0].sql_type), *now[k][1:])
            case "change_type":
                k = at(name)
                types.parse(required(op.get("sql_type"), "sql_type"))
                now[k] = (Column(name, op["sql_type"]), *now[k][1:])
            case _:
                raise ValueError(f"unsupported schema operation {kind!r}")
    return relation.project(now)
