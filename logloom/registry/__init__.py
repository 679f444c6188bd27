"""All registered queries and their checking SQL."""

from logloom.registry import capture, cells, files, logs, metrics, quality, routing, scoring, streams  # noqa: F401
from logloom.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
