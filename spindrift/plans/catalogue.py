"""All queries of the reference's operators, with their SQL oracles."""

from __future__ import annotations

from . import files, interaction, labels, network, serve, shapes, spatial  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
