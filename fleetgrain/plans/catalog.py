"""All queries of the telemetry operators, and their SQL."""

from __future__ import annotations

from . import metrics, records, reports, streams

QUERIES, ORACLES = {}, {}
for _part in (metrics, records, reports, streams):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
