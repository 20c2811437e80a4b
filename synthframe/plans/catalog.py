"""All registered queries."""

from __future__ import annotations

from . import encoding, evaluating, modelling, profiling, rules, streams
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "encoding", "evaluating", "modelling", "profiling", "rules", "streams"]
