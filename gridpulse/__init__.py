"""Spark-native analytics for panels of cell traffic: ingest, clean, model, score, report."""

from gridpulse.schemas import FEATURES, KEY, TIME
from gridpulse.session import build_session, configure

__all__ = ["FEATURES", "KEY", "TIME", "build_session", "configure"]
