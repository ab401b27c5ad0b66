"""All queries of the review engine and their SQL twins, by name."""

from __future__ import annotations

from opinara.plans import feedback, ingesting, narratives, series, uploads

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (feedback, ingesting, series, narratives, uploads):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
