"""Every named query of the core with the SQL that gives the same rows."""

from __future__ import annotations

from helixmill.plans import files, mates, prescan, qc, telemetry

_MODULES = (qc, mates, prescan, telemetry, files)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
