"""All registered queries (importing the plan modules fills the registry)."""

from __future__ import annotations

from . import q_basic, q_models, q_pipelines, q_stats  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
