"""Checked queries over the benchmark tables."""

from tidewell.catalog import aggregates, charts, filters, grids, joins, math, sources, streaming, windows
from tidewell.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "aggregates", "charts", "filters", "grids", "joins", "math", "sources", "streaming", "windows"]
