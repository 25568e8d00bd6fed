"""Loads every query module."""

from . import aggregates, joins, models, rows, sources, state, streams, views, windows  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
