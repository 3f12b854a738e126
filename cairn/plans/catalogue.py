"""All registered queries of the library."""

from __future__ import annotations

from . import documents, governance, integrity, machines, measure, replay, store  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
