"""A SELECT's filter and projection over a stream.

Row-wise predicates need no state, so they run on unbounded inputs as they are. Nearest neighbours, order and limit
look at whole tables and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.errors import EngineError
from quarry.operators.filters import to_column
from quarry.plans import syntax as s
from quarry.plans.parser import parse


def _looks_at_all(p) -> bool:
    match p:
        case s.Both() | s.Either():
            return _looks_at_all(p.left) or _looks_at_all(p.right)
        case s.Not():
            return _looks_at_all(p.inner)
    return isinstance(p, s.Nearest)


def select_stream(stream: DataFrame, sql: str) -> DataFrame:
    """The rows of a streaming DataFrame that a SELECT keeps; its table name is not looked up."""
    (q,) = parse(sql)
    if not isinstance(q, s.Select) or q.order_by or q.limit is not None or (q.where and _looks_at_all(q.where)):
        raise EngineError("a stream takes a SELECT without ORDER BY, LIMIT and KNN")
    rows = stream if q.where is None else stream.where(to_column(q.where, stream))
    return rows if q.columns is None else rows.select(*[F.col(f"`{c}`") for c in q.columns])
