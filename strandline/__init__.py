"""Strandline: one Spark session, three views of data (relational tables, metrics, logs)."""

from strandline.session import get_session

__all__ = ["get_session"]
