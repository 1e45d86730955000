"""Importing this module fills the registry."""

from riskflow.catalog import analytics_entries, feature_entries, model_entries, online_entries, stream_entries, table_entries  # noqa: F401
from riskflow.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
