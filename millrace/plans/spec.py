"""Pipelines as JSON documents: what fields they may have, and strict reading."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

MISSING = object()
ANY = object()


class SpecError(ValueError):
    pass


_COLUMN = {"name": str, "sql_type": str}
_RULE = {"column": str, "operation": str, "value": ANY}
_SORT = {"column": str, "direction": str, "nulls": str}
#: Fields of each node type's configuration. A list holds items of its one entry.
CONFIGS: dict[str, dict] = {
    "DataSource": {"format": str, "path": str, "mode": str, "columns": [_COLUMN], "options": {"header": bool}},
    "SelectColumns": {"columns": [str]},
    "Filter": {"mode": str, "rules": [_RULE]},
    "Sort": {"keys": [_SORT]},
    "Limit": {"count": int, "offset": int},
    "LimitSample": {"count": int, "offset": int},
    "ConstantColumn": {"column": _COLUMN, "value": ANY},
    "ComputeColumn": {"columns": [_COLUMN | {"expr": str}]},
    "RenameColumns": {"renames": [{"from": str, "to": str}]},
    "CastColumns": {"casts": [{"column": str, "sql_type": str}]},
    "FillReplace": {"rules": [{"column": str, "fill_null_with": ANY, "replace_from": ANY, "replace_to": ANY}]},
    "Deduplicate": {"columns": [str], "keep": str, "order_by": [_SORT]},
    "Aggregate": {"group_by": [str], "metrics": [{"function": str, "column": str, "as": str}]},
    "MergeUnion": {"mode": str},
    "Join": {"mode": str, "keys": [{"left": str, "right": str}]},
    "Conditional": {"mode": str, "rules": [_RULE]},
    "Switch": {"branches": [{"label": str, "mode": str, "rules": [_RULE]}]},
    "UnnestArray": {"array_column": str, "output_column": _COLUMN},
    "Pivot": {"group_by": [str], "pivot_column": str, "value_column": str, "agg_fn": str, "in_values": [str]},
    "Unpivot": {"passthrough": [str], "name_column": _COLUMN, "value_column": _COLUMN, "in_columns": [str]},
}
DOCUMENT = {
    "pipeline_id": str,
    "version": int,
    "defaults": {"telemetry_format": str, "telemetry_level": str},
    "nodes": [{"id": str, "type": str, "inputs": ANY, "config": ANY}],
    "sinks": [{"node_id": str, "target_table": str, "target": {"type": str, "format": str, "path": str, "mode": str}}],
}
_KINDS = {str: "a string", int: "an integer", bool: "a boolean"}


def decode(value: Any, shape: Any, where: str = "") -> Any:
    """The value as far as it fits a shape; unknown fields and other kinds are errors. null stands for a field not given."""
    if shape is ANY or value is None:
        return value
    if isinstance(shape, list):
        if not isinstance(value, list):
            raise SpecError(f"{where or 'value'} must be an array")
        return [decode(v, shape[0], f"{where}[{k}]") for k, v in enumerate(value)]
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            raise SpecError(f"{where or 'value'} must be an object")
        if unknown := next((k for k in value if k not in shape), None):
            raise SpecError(f'unknown field "{unknown}"')
        return {k: decode(v, shape[k], f"{where}.{k}" if where else k) for k, v in value.items()}
    if not isinstance(value, shape) or shape is int and isinstance(value, bool):
        raise SpecError(f"{where or 'value'} must be {_KINDS[shape]}")
    return value


@dataclass(frozen=True)
class Node:
    id: str
    type: str
    inputs: Any = MISSING
    config: Any = MISSING


@dataclass(frozen=True)
class Sink:
    node_id: str
    target_table: str
    target: dict | None = None


@dataclass(frozen=True)
class Spec:
    pipeline_id: str
    version: int
    nodes: tuple[Node, ...]
    sinks: tuple[Sink, ...]
    defaults: dict = field(default_factory=dict)


def parse(document: dict) -> Spec:
    """A decoded JSON document as a pipeline; SpecError where its shape is wrong."""
    d = decode(document, DOCUMENT)
    if not isinstance(d, dict):
        raise SpecError("the document must be an object")
    nodes = tuple(Node((n or {}).get("id") or "", (n or {}).get("type") or "", (n or {}).get("inputs", MISSING), (n or {}).get("config", MISSING)) for n in d.get("nodes") or [])
    sinks = tuple(Sink((s or {}).get("node_id") or "", (s or {}).get("target_table") or "", (s or {}).get("target")) for s in d.get("sinks") or [])
    return Spec(d.get("pipeline_id") or "", d.get("version") or 0, nodes, sinks, d.get("defaults") or {})


def load(text: str | bytes | dict) -> Spec:
    return parse(text if isinstance(text, dict) else json.loads(text))


def sink_ref(text: str) -> tuple[str, str]:
    """(node id, label in lower case or "") of a reference to a node's output."""
    parts = text.strip().split(":")
    if not parts[0].strip():
        raise SpecError("sink node_id is required")
    if len(parts) > 2:
        raise SpecError("sink node_id must be node_id or node_id:label")
    if len(parts) == 1:
        return parts[0].strip(), ""
    if not parts[1].strip():
        raise SpecError("sink label is required when using node_id:label")
    return parts[0].strip(), parts[1].strip().lower()
