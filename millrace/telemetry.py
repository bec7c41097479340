"""Events of runs as text or JSON lines, at the level basic or debug."""

from __future__ import annotations

import json
import sys
import time
from typing import Any, TextIO


class Telemetry:
    def __init__(self, style: str = "text", level: str = "basic", out: TextIO | None = None):
        if style not in ("text", "json"):
            raise ValueError("telemetry format must be text or json")
        if level not in ("basic", "debug"):
            raise ValueError("telemetry level must be basic or debug")
        self.style, self.level, self.out = style, level, out or sys.stdout

    def event(self, name: str, **fields: Any) -> None:
        if self.style == "json":
            line = json.dumps({"event": name, "ts": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **fields}, default=str)
        else:
            line = f"[{name}] " + " ".join(f"{k}={v}" for k, v in fields.items())
        print(line, file=self.out, flush=True)

    def debug(self, name: str, **fields: Any) -> None:
        if self.level == "debug":
            self.event(name, **fields)
