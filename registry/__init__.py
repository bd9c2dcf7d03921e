"""Registered queries: every operator over the given tables, with its SQL counterpart."""

from registry import aggregates, features, preparation, ranking, reports, sources, themes  # noqa: F401
from registry.core import ORACLES, QUERIES  # noqa: F401
