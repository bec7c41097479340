"""Static checks of pipelines. Issues of all nodes are gathered.

Each node type has a list of checks, which are functions from (configuration, path)
to issues; what they say is a fixed part of the interface.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from millrace.functions.expressions import OPERATIONS

from . import graph
from .errors import Issue, ValidationError
from .spec import CONFIGS, MISSING, Node, Spec, SpecError, decode, parse, sink_ref

Check = Callable[[Any, str], Iterator[Issue]]


def _blank(value: Any) -> bool:
    return value is None or isinstance(value, str) and not value.strip()


def _at(value: dict | None, field: str) -> Any:
    for name in field.split("."):
        value = (value or {}).get(name)
    return value


def _named(field: str) -> str:
    return field.rpartition(".")[2].replace("_", " ")


def needs(field: str) -> Check:
    """A text that isn't blank, or a list that isn't empty."""

    def check(config, path):
        value = _at(config, field)
        if not value or _blank(value):
            yield Issue("SCHEMA_REQUIRED", f"{_named(field)} must be given", f"{path}.{field}")

    return check


def one_of(field: str, allowed: tuple[str, ...], optional: bool = False) -> Check:
    def check(config, path):
        value = _at(config, field) or ""
        if value not in allowed and not (optional and value == ""):
            yield Issue("SCHEMA_INVALID", f"{_named(field)} must be one of: {', '.join(allowed)}", f"{path}.{field}")

    return check


def must(field: str, holds: Callable[[dict], bool], message: str) -> Check:
    def check(config, path):
        if not holds(config):
            yield Issue("SCHEMA_INVALID", message, f"{path}.{field}")

    return check


def each(field: str, *checks: Check) -> Check:
    def check(config, path):
        for k, item in enumerate(_at(config, field) or []):
            for c in checks:
                yield from c(item or {}, f"{path}.{field}[{k}]")

    return check


def each_text(field: str) -> Check:
    def check(config, path):
        for k, item in enumerate(_at(config, field) or []):
            if _blank(item):
                yield Issue("SCHEMA_REQUIRED", f"blank entry in {_named(field)}", f"{path}.{field}[{k}]")

    return check


def when(holds: Callable[[dict], bool], *checks: Check) -> Check:
    def check(config, path):
        for c in checks if holds(config) else ():
            yield from c(config, path)

    return check


def _labels(config, path):
    seen = set()
    for k, branch in enumerate(config.get("branches") or []):
        here, label = f"{path}.branches[{k}]", ((branch or {}).get("label") or "").strip().lower()
        for c in (needs("label"), MODE):
            yield from c(branch or {}, here)
        if label == "default":
            yield Issue("SCHEMA_INVALID", "no branch can be called default", f"{here}.label")
        if label and label in seen:
            yield Issue("SCHEMA_INVALID", "two branches have one label", f"{here}.label")
        seen.add(label)
        yield from RULES(branch or {}, here)


MODE = one_of("mode", ("all", "any"), optional=True)
RULES = each("rules", needs("column"), one_of("operation", OPERATIONS))
LIMIT = [must("count", lambda c: (c.get("count") or 0) > 0, "a limit takes at least one row"), must("offset", lambda c: (c.get("offset") or 0) >= 0, "an offset can't be negative")]
CHECKS: dict[str, list[Check]] = {
    "DataSource": [
        one_of("format", ("csv", "parquet")),
        must("options.header", lambda c: c.get("format") != "parquet" or _at(c, "options.header") is None, "only CSV files have a header option"),
        needs("path"),
        one_of("mode", ("infer", "declared", "declared_with_check")),
        when(lambda c: c.get("mode") in ("declared", "declared_with_check"), needs("columns")),
        each("columns", needs("name"), needs("sql_type")),
    ],
    "Filter": [MODE, needs("rules"), RULES],
    "SelectColumns": [needs("columns"), each_text("columns")],
    "Sort": [
        needs("keys"),
        each("keys", needs("column"), one_of("direction", ("asc", "desc"), optional=True), one_of("nulls", ("first", "last"), optional=True)),
    ],
    "Limit": LIMIT,
    "LimitSample": LIMIT,
    "ConstantColumn": [needs("column.name"), needs("column.sql_type")],
    "ComputeColumn": [
        needs("columns"),
        each("columns", needs("name"), needs("sql_type"), needs("expr")),
    ],
    "RenameColumns": [needs("renames"), each("renames", needs("from"), needs("to"))],
    "CastColumns": [needs("casts"), each("casts", needs("column"), needs("sql_type"))],
    "FillReplace": [needs("rules"), each("rules", needs("column"))],
    "Deduplicate": [needs("columns"), one_of("keep", ("first", "last"), optional=True), needs("order_by")],
    "Aggregate": [
        needs("metrics"),
        each("metrics", one_of("function", ("count", "sum", "avg", "min", "max")), needs("column"), needs("as")),
    ],
    "MergeUnion": [one_of("mode", ("strict_positional", "align_by_name"))],
    "Join": [
        one_of("mode", ("inner", "left")),
        needs("keys"),
        each("keys", needs("left"), needs("right")),
    ],
    "Conditional": [MODE, RULES],
    "Switch": [needs("branches"), _labels],
    "UnnestArray": [needs("array_column"), needs("output_column.name"), needs("output_column.sql_type")],
    "Pivot": [
        needs("group_by"),
        needs("pivot_column"),
        needs("value_column"),
        one_of("agg_fn", ("sum", "count"), optional=True),
        needs("in_values"),
    ],
    "Unpivot": [
        needs("in_columns"),
        needs("name_column.name"),
        needs("name_column.sql_type"),
        needs("value_column.name"),
        needs("value_column.sql_type"),
    ],
}
#: Least and most inputs; others have one.
INPUTS = {"MergeUnion": (2, None)}


def listed_inputs(raw: Any, least: int, most: int | None, path: str) -> tuple[list[str], list[Issue]]:
    if raw is MISSING:
        return [], [Issue("SCHEMA_REQUIRED", "inputs are required", path)]
    try:
        found = [x or "" for x in decode(raw, [str]) or []]
    except SpecError:
        return [], [Issue("SCHEMA_INVALID", "inputs must be an array of node ids", path)]
    issues = []
    if len(found) < least:
        issues.append(Issue("SCHEMA_INVALID", f"requires at least {least} input(s)", path))
    if most is not None and len(found) > most:
        issues.append(Issue("SCHEMA_INVALID", f"requires at most {most} input(s)", path))
    for k, name in enumerate(found):
        if _blank(name):
            issues.append(Issue("SCHEMA_REQUIRED", "input id is required", f"{path}[{k}]"))
        elif name in found[:k]:
            issues.append(Issue("NODE_DUPLICATE_INPUT", f'duplicate input "{name}"', f"{path}[{k}]"))
    return found, issues


def joined_inputs(raw: Any, path: str) -> tuple[list[str], list[Issue]]:
    if raw is MISSING:
        return [], [Issue("SCHEMA_REQUIRED", "inputs are required", path)]
    try:
        found = decode(raw, {"left": str, "right": str}) or {}
    except SpecError:
        return [], [Issue("SCHEMA_INVALID", "join inputs must be an object with left/right", path)]
    sides = [found.get("left") or "", found.get("right") or ""]
    issues = [Issue("SCHEMA_REQUIRED", f"{side} input is required", f"{path}.{side}") for side, name in zip(("left", "right"), sides, strict=True) if _blank(name)]
    if sides[0] and sides[0] == sides[1]:
        issues.append(Issue("NODE_DUPLICATE_INPUT", "left and right cannot point to the same node", path))
    return sides, issues


def inputs_of(node: Node, path: str = "$") -> tuple[list[str], list[Issue]]:
    if node.type == "DataSource":
        return [], [] if node.inputs is MISSING else [Issue("NODE_INPUTS_FORBIDDEN", "DataSource cannot declare inputs", path)]
    if node.type == "Join":
        return joined_inputs(node.inputs, path)
    return listed_inputs(node.inputs, *INPUTS.get(node.type, (1, 1)), path)


def _node(node: Node, path: str) -> tuple[list[Issue], list[str]]:
    if node.config is MISSING:
        return [Issue("SCHEMA_REQUIRED", "config is required", f"{path}.config")], []
    if node.type not in CONFIGS:
        return [Issue("SCHEMA_INVALID", f'unsupported node type "{node.type}"', f"{path}.type")], []
    inputs, issues = inputs_of(node, f"{path}.inputs")
    try:
        config = decode(node.config, CONFIGS[node.type]) or {}
    except SpecError as e:
        return [*issues, Issue("SCHEMA_INVALID", str(e), f"{path}.config")], inputs
    return issues + [i for check in CHECKS[node.type] for i in check(config, f"{path}.config")], inputs


def _switch_labels(node: Node) -> set[str]:
    try:
        config = decode(node.config if node.config is not MISSING else None, CONFIGS["Switch"]) or {}
    except SpecError:
        config = {}
    return {"default", *((b or {}).get("label", "").strip().lower() for b in config.get("branches") or [])} - {""}


def _sinks(spec: Spec, nodes: dict[str, Node]) -> Iterator[Issue]:
    paths: dict[str, str] = {}
    for k, sink in enumerate(spec.sinks):
        here = f"$.sinks[{k}]"
        if _blank(sink.node_id):
            yield Issue("SCHEMA_REQUIRED", "sink node_id is required", f"{here}.node_id")
            continue
        try:
            name, label = sink_ref(sink.node_id)
        except SpecError as e:
            yield Issue("SCHEMA_INVALID", str(e), f"{here}.node_id")
            continue
        if _blank(sink.target_table):
            yield Issue("SCHEMA_REQUIRED", "sink target_table is required", f"{here}.target_table")
        if sink.target is not None:
            target = {f: (sink.target.get(f) or "").strip() for f in ("type", "path", "format")} | {"mode": sink.target.get("mode") or ""}
            if target["type"] != "file":
                yield Issue("SCHEMA_INVALID", "sink target type must be file", f"{here}.target.type")
            if not target["path"]:
                yield Issue("SCHEMA_REQUIRED", "sink target path is required", f"{here}.target.path")
            elif prior := paths.get(target["path"].lower()):
                yield Issue("SINK_DUPLICATE_TARGET_PATH", f'multiple sinks target path "{prior}"', f"{here}.target.path")
            else:
                paths[target["path"].lower()] = sink.target["path"]
            if target["format"] not in ("csv", "parquet"):
                yield Issue("SCHEMA_INVALID", "sink target format must be csv or parquet", f"{here}.target.format")
            if target["mode"] not in ("", "overwrite"):
                yield Issue("SCHEMA_INVALID", "sink target mode must be overwrite", f"{here}.target.mode")
        if name not in nodes:
            yield Issue("SINK_UNKNOWN_NODE", f'sink references unknown node "{name}"', f"{here}.node_id")
        elif label:
            kind = nodes[name].type
            if kind == "Conditional" and label not in ("if", "else"):
                yield Issue("SINK_INVALID_LABEL", "conditional sink label must be if or else", f"{here}.node_id")
            elif kind == "Switch" and label not in _switch_labels(nodes[name]):
                yield Issue("SINK_INVALID_LABEL", f'switch sink label "{label}" is not declared', f"{here}.node_id")
            elif kind not in ("Conditional", "Switch"):
                yield Issue("SINK_INVALID_LABEL", "sink label is only allowed for Conditional or Switch nodes", f"{here}.node_id")


def issues_of(spec: Spec) -> list[Issue]:
    issues: list[Issue] = []
    if _blank(spec.pipeline_id):
        issues.append(Issue("SCHEMA_REQUIRED", "pipeline id must be given", "$.pipeline_id"))
    if spec.version < 1:
        issues.append(Issue("SCHEMA_INVALID", "versions count from 1", "$.version"))
    if not spec.nodes:
        return [*issues, Issue("SCHEMA_REQUIRED", "a pipeline has a node at least", "$.nodes")]
    if not spec.sinks:
        issues.append(Issue("SCHEMA_REQUIRED", "a pipeline has a sink at least", "$.sinks"))
    for field, allowed in (("telemetry_format", ("text", "json")), ("telemetry_level", ("basic", "debug"))):
        issues += one_of(field, allowed, optional=True)(spec.defaults, "$.defaults")
    nodes: dict[str, Node] = {}
    places: dict[str, int] = {}
    inputs: dict[str, list[str]] = {}
    for k, node in enumerate(spec.nodes):
        path = f"$.nodes[{k}]"
        if _blank(node.id):
            issues.append(Issue("SCHEMA_REQUIRED", "node id is required", f"{path}.id"))
        elif node.id in nodes:
            issues.append(Issue("NODE_DUPLICATE_ID", f'duplicate node id "{node.id}" (already declared at index {places[node.id]})', f"{path}.id"))
        else:
            nodes[node.id], places[node.id] = node, k
            found, inputs[node.id] = _node(node, path)
            issues += found
    about: list[Issue] = []
    for k, node in enumerate(spec.nodes):
        for name in inputs.get(node.id, []):
            if name not in nodes:
                about.append(Issue("NODE_MISSING_DEPENDENCY", f'dependency "{name}" does not exist', f"$.nodes[{k}].inputs"))
            elif name == node.id:
                about.append(Issue("NODE_SELF_DEPENDENCY", "node cannot depend on itself", f"$.nodes[{k}].inputs"))
    about += _sinks(spec, nodes)
    if not about:
        try:
            graph.order(list(nodes.values()), inputs)
        except ValueError:
            about.append(Issue("GRAPH_CYCLE", "cycle detected in pipeline graph", "$.nodes"))
    return issues + about


def parse_and_validate(document: str | bytes | dict) -> Spec:
    """A pipeline of a JSON document, or ValidationError with all issues."""
    try:
        data = document if isinstance(document, dict) else json.loads(document)
    except ValueError as e:
        raise ValidationError([Issue("INVALID_JSON", "invalid JSON document", "$")]) from e
    try:
        spec = parse(data)
    except SpecError as e:
        raise ValidationError([Issue("SCHEMA_INVALID", str(e), "$")]) from e
    if found := issues_of(spec):
        raise ValidationError(found)
    return spec
