"""Join, Aggregate, Pivot, Unpivot and UnnestArray."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import types
from millrace.functions.expressions import assign_cast, quoted, to_text
from millrace.plans.relation import Column, Relation

from .base import chosen, distinct, listed, operator, required
from .columns import _declared


def joined_names(left: Relation, right: Relation) -> list[tuple[str, Column, str]]:
    """(side, column, output name): all of the left, then of the right; a taken name gets _right, _right_2, _right_3 and so on."""
    out = [("left", c, c.name) for c in left.columns]
    taken = {c.name.lower() for c in left.columns}
    for c in right.columns:
        name, k = c.name, 1
        while name.lower() in taken:
            name = f"{c.name}_right" + (f"_{k}" if k > 1 else "")
            k += 1
        taken.add(name.lower())
        out.append(("right", c, name))
    return out


@operator("Join")
def join(inputs: list[Relation], config: dict) -> Relation:
    """Inner or left join on equal keys; both sides' key columns stay. `select` (side, column, as) chooses the output, by library calls only."""
    left, right = inputs
    mode = chosen(config.get("mode"), ("inner", "left"), "inner", "mode")
    keys = [(left.resolve(required(k.get("left"), "join key left")).name, right.resolve(required(k.get("right"), "join key right")).name) for k in listed(config.get("keys"), "join key")]
    if len(set(keys)) < len(keys):
        raise ValueError("duplicate join key")
    outputs = joined_names(left, right)
    if config.get("select"):
        sides = {"left": left, "right": right}
        outputs = [(chosen(s.get("side"), ("left", "right"), None, "side"), sides[s["side"]].resolve(s.get("column") or ""), required(s.get("as"), "alias")) for s in config["select"]]
        distinct([n for _, _, n in outputs], "output column")
    # Columns get names of their own first, so that inputs of a common origin don't mix.
    a = left.df.select(*(quoted(c.name).alias(f"l{k}") for k, c in enumerate(left.columns)))
    b = right.df.select(*(quoted(c.name).alias(f"r{k}") for k, c in enumerate(right.columns)))
    where = {("left", c.name): f"l{k}" for k, c in enumerate(left.columns)} | {("right", c.name): f"r{k}" for k, c in enumerate(right.columns)}
    on = reduce(lambda x, y: x & y, [F.col(where["left", x]) == F.col(where["right", y]) for x, y in keys])
    df = a.join(b, on, mode).select(*(F.col(where[side, c.name]).alias(name) for side, c, name in outputs))
    return Relation(df, tuple(Column(name, c.sql_type) for _, c, name in outputs))


def _metric(base: Relation, spec: dict) -> tuple[Column, object, T.DataType]:
    function = chosen((spec.get("function") or "").lower(), ("count", "sum", "avg", "min", "max"), None, "metric function")
    name, alias = (spec.get("column") or "").strip(), required(spec.get("as"), "metric alias")
    if function == "count":
        value = F.count(F.lit(1)) if name in ("", "*") else F.count(quoted(base.resolve(name).name))
        return Column(alias, "bigint"), value, T.LongType()
    c = base.resolve(name)
    kind, col = base.kind(c.name), quoted(c.name)
    if function in ("sum", "avg") and not isinstance(kind, types.NUMERIC):
        raise ValueError(f"{function} needs a number column, {c.name!r} is {c.sql_type}")
    if function == "avg":
        return Column(alias, "double"), F.avg(col.cast("double")), T.DoubleType()
    if function == "sum":
        wide = T.DoubleType() if isinstance(kind, (T.FloatType, T.DoubleType)) else T.LongType() if isinstance(kind, types.INTEGRAL) else T.DecimalType(min(38, kind.precision + 10), kind.scale)
        return Column(alias, c.sql_type), F.sum(col), wide
    return Column(alias, c.sql_type), {"min": F.min, "max": F.max}[function](col), kind


@operator("Aggregate")
def aggregate(inputs: list[Relation], config: dict) -> Relation:
    """Group columns, then metrics. A sum has its column's type, so it fails where that overflows; no groups give one row."""
    base = inputs[0]
    keys = [base.resolve(g) for g in config.get("group_by") or []]
    metrics = [_metric(base, m) for m in listed(config.get("metrics"), "metric")]
    distinct([c.name for c in keys] + [c.name for c, _, _ in metrics], "output column")
    inner = [value.alias(f"m{k}") for k, (_, value, _) in enumerate(metrics)]
    grouped = base.df.groupBy(*(quoted(c.name).alias(f"k{k}") for k, c in enumerate(keys))).agg(*inner)
    casts = [assign_cast(F.col(f"m{k}"), kind, types.parse(c.sql_type)).alias(c.name) for k, (c, _, kind) in enumerate(metrics)]
    return Relation(grouped.select(*(F.col(f"k{k}").alias(c.name) for k, c in enumerate(keys)), *casts), (*keys, *(c for c, _, _ in metrics)))


@operator("Pivot")
def pivot(inputs: list[Relation], config: dict) -> Relation:
    """A column for each of in_values, with the sum or count of the value column.

    Rows are grouped by all columns but the pivot and value columns; group_by says
    which of them are put out. pivot_grouping "declared" groups by group_by alone.
    """
    base = inputs[0]
    keys = [base.resolve(g) for g in listed(config.get("group_by"), "group_by column")]
    by, of = base.resolve(required(config.get("pivot_column"), "pivot_column")), base.resolve(required(config.get("value_column"), "value_column"))
    function = chosen(config.get("agg_fn"), ("sum", "count"), "sum", "agg_fn")
    values = [required(v, "in value") for v in listed(config.get("in_values"), "in value")]
    distinct([c.name for c in keys] + values, "output column")
    if {by.name, of.name} & {c.name for c in keys}:
        raise ValueError("pivot and value columns can't be grouped by")
    if function == "sum" and not isinstance(base.kind(of.name), types.NUMERIC):
        raise ValueError(f"sum needs a number column, {of.name!r} is {of.sql_type}")
    groups = keys if config.get("pivot_grouping") == "declared" else [c for c in base.columns if c.name not in (by.name, of.name)]
    text, value = to_text(quoted(by.name), base.kind(by.name)), quoted(of.name)
    rows = base.df.select(*(quoted(c.name) for c in groups), text.alias("__by"), value.alias("__of"))
    sums = [(F.sum if function == "sum" else F.count)(F.when(F.col("__by") == v, F.col("__of"))).alias(f"m{k}") for k, v in enumerate(values)]
    grouped = rows.groupBy(*(quoted(c.name) for c in groups)).agg(*sums)
    made = [Column(v, of.sql_type if function == "sum" else "bigint") for v in values]
    casts = [assign_cast(F.col(f"m{k}"), grouped.schema[f"m{k}"].dataType, types.parse(c.sql_type)).alias(c.name) for k, c in enumerate(made)]
    return Relation(grouped.select(*(quoted(c.name) for c in keys), *casts), (*keys, *made))


@operator("Unpivot")
def unpivot(inputs: list[Relation], config: dict) -> Relation:
    """A row for each of in_columns whose value isn't null, with the passthrough columns; other columns go."""
    base = inputs[0]
    kept = [base.resolve(p) for p in config.get("passthrough") or []]
    melted = [base.resolve(c) for c in listed(config.get("in_columns"), "in column")]
    distinct([c.name for c in melted], "in column")
    if {c.name for c in kept} & {c.name for c in melted}:
        raise ValueError("a passthrough column can't be an in column")
    outputs = []
    for what in ("name_column", "value_column"):
        spec = config.get(what) or {}
        outputs.append(Column(required(spec.get("name"), f"{what}.name"), required(spec.get("sql_type"), f"{what}.sql_type")))
    distinct([c.name for c in (*kept, *outputs)], "output column")
    rows = base.df.unpivot([quoted(c.name) for c in kept], [quoted(c.name) for c in melted], "__name", "__value").filter(F.col("__value").isNotNull())
    kinds = [rows.schema[n].dataType for n in ("__name", "__value")]
    casts = [assign_cast(F.col(n), kind, types.parse(c.sql_type)).alias(c.name) for n, kind, c in zip(("__name", "__value"), kinds, outputs, strict=True)]
    return Relation(rows.select(*(quoted(c.name) for c in kept), *casts), (*kept, *outputs))


@operator("UnnestArray")
def unnest(inputs: list[Relation], config: dict) -> Relation:
    """A row for each element, beside all columns; empty and null arrays give none, null elements a null."""
    base = inputs[0]
    array = base.resolve(required(config.get("array_column"), "array_column"))
    kind = base.kind(array.name)
    if not isinstance(kind, T.ArrayType):
        raise ValueError(f"{array.name!r} isn't an array")
    new = _declared(base, config.get("output_column"))
    rows = base.df.select("*", F.explode(quoted(array.name)).alias("__element"))
    value = assign_cast(F.col("__element"), kind.elementType, types.parse(new.sql_type)).alias(new.name)
    return Relation(rows.select(*(quoted(c.name) for c in base.columns), value), (*base.columns, new))
