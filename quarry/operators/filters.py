"""Predicates of the dialect as boolean Columns over a table's DataFrame."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.errors import EngineError
from quarry.functions import spatial
from quarry.functions.coerce import checked
from quarry.plans import syntax as s
from quarry.schema import DataType, family

_OPERATORS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def _typed(df: DataFrame, name: str) -> tuple[Column, DataType | None]:
    found = next((f for f in df.schema.fields if f.name == name), None)
    if found is None or name.startswith("_"):
        raise EngineError(f"column '{name}' doesn't exist")
    return F.col(f"`{name}`"), family(found.dataType)


def _comparable(kind: DataType | None, name: str) -> DataType:
    if kind is None:
        raise EngineError(f"column '{name}' has a type that the dialect cannot compare")
    return kind


def _point_of(df: DataFrame, p) -> Column:
    column, kind = _typed(df, p.column)
    if kind is not DataType.POINT:
        raise EngineError(f"column '{p.column}' is not of type POINT")
    return column


def to_column(p: s.Predicate, df: DataFrame) -> Column:
    """The predicate over df; nearest neighbours look at all of df."""
    match p:
        case s.Both():
            return to_column(p.left, df) & to_column(p.right, df)
        case s.Either():
            return to_column(p.left, df) | to_column(p.right, df)
        case s.Not():
            return ~to_column(p.inner, df)
        case s.Flag():
            column, kind = _typed(df, p.column)
            if kind is not DataType.BOOL:
                raise EngineError(f"column '{p.column}' is not of type BOOL")
            return column
        case s.Between():
            column, kind = _typed(df, p.column)
            if _comparable(kind, p.column) is DataType.POINT:
                raise EngineError("BETWEEN is not supported for type POINT")
            return column.between(*(F.lit(checked(v, kind, p.column)) for v in (p.low, p.high)))
        case s.Compare():
            column, kind = _typed(df, p.column)
            value = checked(p.value, _comparable(kind, p.column), p.column)
            if kind is not DataType.POINT:
                return _OPERATORS[p.op](column, F.lit(value))
            if p.op not in ("=", "<>"):
                raise EngineError(f"operator {p.op} is not supported for type POINT")
            same = (column["x"] == F.lit(value[0])) & (column["y"] == F.lit(value[1]))
            return same if p.op == "=" else ~same
        case s.Rectangle():
            return spatial.in_rectangle(_point_of(df, p), p.x0, p.y0, p.x1, p.y1)
        case s.Circle():
            return spatial.in_circle(_point_of(df, p), p.x, p.y, p.radius)
        case s.Nearest():
            return spatial.nearest(_point_of(df, p), p.x, p.y, p.k, df)
    raise EngineError("invalid condition")
