"""What operators are: functions from relations and a configuration to a relation, or to one for each output label."""

from __future__ import annotations

from collections.abc import Callable

from millrace.plans.relation import Relation

Result = Relation | dict[str, Relation]
OPERATORS: dict[str, Callable[..., Result]] = {}


def operator(*names: str):
    """Registers apply(inputs, config) for node types."""

    def keep(f):
        OPERATORS.update(dict.fromkeys(names, f))
        return f

    return keep


def required(text: str | None, what: str) -> str:
    if not (text or "").strip():
        raise ValueError(f"{what} is required")
    return text


def listed(items: list | None, what: str) -> list:
    if not items:
        raise ValueError(f"at least one {what} is required")
    return items


def chosen(value: str | None, allowed: tuple[str, ...], default: str | None, what: str) -> str:
    value = (value or "").strip() or default or ""
    if value not in allowed:
        raise ValueError(f"unsupported {what} {value!r}")
    return value


def distinct(names: list[str], what: str) -> None:
    seen = set()
    for n in names:
        if n.strip().lower() in seen:
            raise ValueError(f"duplicate {what} {n!r}")
        seen.add(n.strip().lower())
