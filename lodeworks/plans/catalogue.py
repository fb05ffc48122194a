"""Every core query by name, with the SQL that says the same where SQL can."""

from __future__ import annotations

from lodeworks.plans import diffs, exports, questions, resolution, snapshots

_MODULES = (snapshots, diffs, questions, resolution, exports)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
