"""The packet view as DuckDB SQL: the fixture text of FIXTURES.md, used by the oracles only."""

from __future__ import annotations

import re
from pathlib import Path

_TEXT = (Path(__file__).resolve().parents[2] / "FIXTURES.md").read_text()
PACKET_SQL = re.search(r"```sql\n(.*?)```", _TEXT, re.S)[1].strip()


def oracle(sql: str) -> str:
    """A query over `p` (the packet view); further CTEs start with a comma-free `name AS (...)`."""
    head = f"WITH p AS MATERIALIZED (\n{PACKET_SQL}\n)"
    body = sql.strip()
    return f"{head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"{head}\n{body}"
