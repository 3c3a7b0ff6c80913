"""Registry of this subpackage's queries and SQL."""

from __future__ import annotations

from occuspan.llm import components, digests, leakage, pii, quotas, survivors, tokens

_MODULES = (digests, survivors, components, quotas, tokens, leakage, pii)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
