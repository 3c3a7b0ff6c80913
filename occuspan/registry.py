"""Registry of the core queries and their DuckDB counterparts."""

from __future__ import annotations

from occuspan.operators import aggregates, alignment, barcode_clusters, calling, cooccupancy, filters, intervals, joins, kernels, motifs, occupancy, ordered, pwm, quality

_MODULES = (intervals, occupancy, alignment, filters, calling, aggregates, joins, ordered, motifs, barcode_clusters, kernels, cooccupancy, pwm, quality)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
