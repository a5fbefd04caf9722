"""Risk report: rows from the graph, rendered as JSON or Markdown; and the answer envelope."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame


def rendered(register: DataFrame, fmt: str = "markdown", top: int = 20) -> str:
    """The first ``top`` rows of a risk register; only these reach the driver."""
    rows = [r.asDict(recursive=True) for r in register.orderBy("position").limit(top).collect()]
    if fmt == "json":
        return json.dumps({"risks": rows}, default=str, indent=1)
    if fmt != "markdown":
        raise ValueError("fmt is json or markdown")
    if not rows:
        return "No linked vulnerabilities.\n"
    head = list(rows[0])
    cell = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"| {' | '.join(head)} |", f"|{'---|' * len(head)}", *(f"| {' | '.join(cell(r[h]) for h in head)} |" for r in rows)]
    return "\n".join(lines) + "\n"


def envelope(tool: str, rows: DataFrame | None = None, error: str | None = None, limit: int = 100, **asked: Any) -> dict:
    """An answer as a plain dict: what was asked, rows up to a limit and whether there are more, or an error."""
    if error is not None or rows is None:
        return {"ok": False, "tool": tool, "asked": asked, "error": error or "no result"}
    got = [r.asDict(recursive=True) for r in rows.limit(limit + 1).collect()]
    return {"ok": True, "tool": tool, "asked": asked, "rows": got[:limit], "truncated": len(got) > limit}


def checked_hops(hops: int) -> int:
    """Hops as a tool takes them: whole numbers from 1 to 12, else an error (the library itself clamps)."""
    if not isinstance(hops, int) or isinstance(hops, bool) or not 1 <= hops <= 12:
        raise ValueError("max_hops is a whole number from 1 to 12")
    return hops


def checked_coordinate(gav: str) -> tuple[str, str, str]:
    parts = [p.strip() for p in (gav or "").split(":")]
    if len(parts) != 3 or not all(parts):
        raise ValueError("a coordinate is group:artifact:version")
    return parts[0], parts[1], parts[2]
