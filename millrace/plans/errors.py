"""What can be wrong with a plan, and what can go wrong as it runs."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Issue:
    code: str
    message: str
    path: str

    def as_dict(self) -> dict[str, str]:
        return asdict(self)


class ValidationError(ValueError):
    def __init__(self, issues: list[Issue]):
        self.issues = issues
        super().__init__("; ".join(f"{i.code} at {i.path}: {i.message}" for i in issues) or "pipeline validation failed")


class WorkflowError(RuntimeError):
    """code, stage, and the node where one is concerned."""

    def __init__(self, code: str, stage: str, message: str, node_id: str = "", node_type: str = "", cause: BaseException | None = None):
        self.code, self.stage, self.message, self.node_id, self.node_type, self.cause = code, stage, message, node_id, node_type, cause
        where = f" node={node_id}" if node_id else ""
        super().__init__(f"{code} stage={stage}{where}: {message}")
