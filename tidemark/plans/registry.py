"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

from tidemark.plans import core_problems, form, inventory, prospective

_MODULES = (core_problems, form, prospective, inventory)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
FLAGSHIP = "p3_found"
