"""Order, limit and pages. Ties are broken by the table's key, so results are total orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.errors import EngineError


def sort_keys(order_by: str | None, ascending: bool, tie: list[str]) -> list:
    keys = [F.col(f"`{t}`").asc() for t in tie if t != order_by]
    if order_by is None:
        return keys
    first = F.col(f"`{order_by}`")
    return [first.asc() if ascending else first.desc(), *keys]


def limited(df: DataFrame, keys: list, limit: int | None) -> DataFrame:
    """The first rows in order: each task keeps its own, and only those are merged."""
    if limit is None:
        return df
    if limit <= 0:
        raise EngineError("the limit must be positive")
    return (df.orderBy(*keys) if keys else df).limit(limit)


def page(df: DataFrame, keys: list, offset: int, limit: int) -> DataFrame:
    return (df.orderBy(*keys) if keys else df).offset(offset).limit(limit)
