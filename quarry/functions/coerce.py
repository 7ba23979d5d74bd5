"""Values into the types of declared columns."""

from __future__ import annotations

import datetime
import struct
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.errors import EngineError
from quarry.schema import ColumnDef, DataType

INT_LOW, INT_HIGH = -(2**31), 2**31 - 1
_POINT = r"^\s*\(?\s*([^,()\s]+)\s*,\s*([^,()\s]+)\s*\)?\s*$"


def single_precision(value: float) -> float:
    """A FLOAT as it is kept: through single precision, to six decimals."""
    try:
        return round(struct.unpack("<f", struct.pack("<f", value))[0], 6)
    except OverflowError:
        raise EngineError(f"value {value!r} is out of range for FLOAT") from None


def float_column(c: Column) -> Column:
    return F.round(c.cast("float").cast("double"), 6)


def literal_type(value: Any) -> DataType:
    for kind, of in ((bool, DataType.BOOL), (int, DataType.INT), (float, DataType.FLOAT), (str, DataType.VARCHAR)):
        if isinstance(value, kind):
            return of
    return DataType.POINT


def checked(value: Any, of: DataType, name: str) -> Any:
    """A literal for a column of a type. There are no implicit casts; a DATE is written as an ISO string."""
    if of is DataType.DATE and isinstance(value, str):
        try:
            return datetime.date.fromisoformat(value)
        except ValueError:
            raise EngineError(f"value '{value}' is no date (column '{name}')") from None
    if literal_type(value) is not of:
        raise EngineError(f"value '{value}' is not of type {of} (column '{name}')")
    return value


def stored(value: Any, c: ColumnDef) -> Any:
    """A literal as it is kept in a declared column."""
    value = checked(value, c.type, c.name)
    if c.type is DataType.INT and not INT_LOW <= value <= INT_HIGH:
        raise EngineError(f"value {value} is out of range for INT (column '{c.name}')")
    if c.type is DataType.VARCHAR and len(value) > c.length:
        raise EngineError(f"value '{value}' is longer than VARCHAR({c.length}) (column '{c.name}')")
    if c.type is DataType.FLOAT:
        return single_precision(value)
    if c.type is DataType.POINT:
        return tuple(map(single_precision, value))
    return value


def from_text(text: Column, c: ColumnDef) -> tuple[Column, Column]:
    """(value, whether it is valid) of a CSV cell for a declared column."""
    cell = F.trim(text)
    match c.type:
        case DataType.INT:
            value = cell.try_cast("int")
        case DataType.FLOAT:
            value = float_column(cell.try_cast("double"))
        case DataType.BOOL:
            return F.lower(cell).isin("1", "true", "yes"), text.isNotNull()
        case DataType.DATE:
            value = cell.try_cast("date")
        case DataType.POINT:
            x, y = (float_column(F.regexp_extract(text, _POINT, i).try_cast("double")) for i in (1, 2))
            return F.struct(x.alias("x"), y.alias("y")), x.isNotNull() & y.isNotNull()
        case DataType.VARCHAR:
            value = F.coalesce(text, F.lit(""))
            return value, F.length(value) <= c.length
    return value, value.isNotNull()


def from_column(column: Column, c: ColumnDef) -> Column:
    """A DataFrame's column as a declared column keeps it."""
    match c.type:
        case DataType.FLOAT:
            return float_column(column)
        case DataType.POINT:
            return F.struct(float_column(column["x"]).alias("x"), float_column(column["y"]).alias("y"))
        case DataType.VARCHAR:
            return column.cast("string")
    return column.cast({DataType.INT: "int", DataType.BOOL: "boolean", DataType.DATE: "date"}[c.type])


def shown(value: Any) -> Any:
    """A value as results show it: points as text."""
    return str((value["x"], value["y"])) if hasattr(value, "asDict") and {"x", "y"} == set(value.asDict()) else value
