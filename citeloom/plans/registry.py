"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import analytics, evidence, runs, web

FLAGSHIP = "quote_grounding"
QUERIES: dict = {}
ORACLES: dict = {}
for _module in (evidence, web, analytics, runs):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
