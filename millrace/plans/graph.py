"""The order in which nodes run."""

from __future__ import annotations

from collections import deque

from .spec import Node


def order(nodes: list[Node], inputs: dict[str, list[str]]) -> list[Node]:
    """Nodes after their inputs, else as declared. ValueError where an input doesn't exist or there is a cycle."""
    known = {n.id: n for n in nodes}
    waiting = {n.id: len(inputs[n.id]) for n in nodes}
    users: dict[str, list[str]] = {n.id: [] for n in nodes}
    for n in nodes:
        for i in inputs[n.id]:
            if i not in known:
                raise ValueError(f"node {n.id!r} depends on {i!r}, which doesn't exist")
            users[i].append(n.id)
    ready, out = deque(n.id for n in nodes if not waiting[n.id]), []
    while ready:
        now = ready.popleft()
        out.append(known[now])
        for u in users[now]:
            waiting[u] -= 1
            if not waiting[u]:
                ready.append(u)
    if len(out) < len(nodes):
        raise ValueError("cycle detected in pipeline graph")
    return out
