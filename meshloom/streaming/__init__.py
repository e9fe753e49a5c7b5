"""Scans that arrive over time."""

from .integrate import Session, integrate_stream  # noqa: F401
