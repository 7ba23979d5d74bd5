"""A table engine on Spark DataFrames: a compact SQL dialect, spatial predicates, versioned Parquet tables."""

from quarry.errors import EngineError, ParseError, QuarryError
from quarry.session import Session

__all__ = ["EngineError", "ParseError", "QuarryError", "Session"]
