"""All registered queries."""

from . import board, chart, explore, filters, ingest, markets, stewardship, streaming, timeseries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
