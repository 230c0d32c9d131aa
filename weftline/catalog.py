"""Every query that the library registers, with the SQL it is checked against."""

from __future__ import annotations

from weftline.plans import annotation, captions, chains, faces, geometry, graphs, ledger, library, neighbours, planner, retrieval, review, solids, streams, vision  # noqa: F401  they register
from weftline.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
