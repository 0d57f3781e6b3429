"""The queries of this subpackage by name, and SQL for those that plain SQL can express.

The modules are imported here, so that one whose libraries are missing fails when the subpackage is imported, where the
caller can do without it, and not when its queries are asked for.
"""

from __future__ import annotations

from ..session import scoped
from . import copies, leaks, links, mixing, near, quality, scans

_MODULES = [copies, links, near, leaks, scans, mixing, quality]


def queries() -> dict:
    out = {}
    for m in _MODULES:
        out |= m.QUERIES
    return {name: scoped(build) for name, build in out.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in _MODULES:
        out |= getattr(m, "SQL", {})
    return out
