"""All registered queries of the core and the SQL that checks them."""

from __future__ import annotations

from ..session import scoped
from . import further, layouts, p2_timestamps, relational, stored, textual

_MODULES = [p2_timestamps, relational, textual, further, stored, layouts]


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
