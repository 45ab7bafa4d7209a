"""All named queries: importing the plan modules fills the registry."""

from __future__ import annotations

from . import (  # noqa: F401
    access, analytics, audit, changes, indexed, listings, maintained, partitions, quality, sources, streams,
)
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
