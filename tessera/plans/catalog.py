"""The queries of the engine's own operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from tessera.plans import evaluation, evidence, files, inference, screening, statistics  # noqa: F401  (they register their queries)
from tessera.plans.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
