"""All registered queries of the engine with their DuckDB SQL."""

from . import analytics, detection, reporting, station, storage, streams  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
