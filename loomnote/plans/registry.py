"""Every query of the library and its oracle SQL, by name."""

from . import apply, assembly, capture, curation, feeds, graphs, lint, searches, texts  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
