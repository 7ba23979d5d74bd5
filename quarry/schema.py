"""Types, columns and table schemas, and their Spark forms."""

from __future__ import annotations

from collections import Counter
from dataclasses import asdict, dataclass, field, replace
from enum import StrEnum

from pyspark.sql import types as T

from quarry.errors import EngineError

#: The hidden row number of declared tables; their default order.
ROW_ID = "_rid"


class DataType(StrEnum):
    INT = "INT"
    FLOAT = "FLOAT"
    VARCHAR = "VARCHAR"
    DATE = "DATE"
    BOOL = "BOOL"
    POINT = "POINT"


class IndexKind(StrEnum):
    NONE = "NONE"
    AVL = "AVL"
    ISAM = "ISAM"
    HASH = "HASH"
    BTREE = "BTREE"
    RTREE = "RTREE"
    BRIN = "BRIN"


POINT_TYPE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
SPARK_TYPES = {DataType.INT: T.IntegerType(), DataType.FLOAT: T.DoubleType(), DataType.VARCHAR: T.StringType(), DataType.DATE: T.DateType(), DataType.BOOL: T.BooleanType(), DataType.POINT: POINT_TYPE}


def family(kind: T.DataType) -> DataType | None:
    """The dialect's type for a Spark type; None if its values cannot be compared in the dialect."""
    if isinstance(kind, T.IntegralType):
        return DataType.INT
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return DataType.FLOAT
    if isinstance(kind, T.StructType):
        fits = [f.name for f in kind.fields] == ["x", "y"] and all(isinstance(f.dataType, T.NumericType) for f in kind.fields)
        return DataType.POINT if fits else None
    for mine, sparks in SPARK_TYPES.items():
        if kind == sparks:
            return mine
    return None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: DataType
    primary: bool = False
    index: IndexKind = IndexKind.NONE
    length: int | None = None
    index_name: str | None = None

    def field(self) -> T.StructField:
        about = {"index": self.index.value, "pk": self.primary} | ({"varchar": self.length} if self.length else {})
        return T.StructField(self.name, SPARK_TYPES[self.type], True, about)


def check_index(kind: IndexKind, of: DataType) -> None:
    if kind is IndexKind.RTREE and of is not DataType.POINT:
        raise EngineError(f"an RTREE index does not support type {of}")
    if of is DataType.POINT and kind not in (IndexKind.RTREE, IndexKind.NONE):
        raise EngineError(f"a {kind} index does not support type POINT")


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[ColumnDef, ...] = field(default=())

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> ColumnDef | None:
        return next((c for c in self.columns if c.name == name), None)

    def spark(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns] + [T.StructField(ROW_ID, T.LongType())])

    def validated(self) -> TableSchema:
        """The schema with defaults filled in: the primary key's index and the names of indexes."""
        if not self.columns:
            raise EngineError("a table needs at least one column")
        if twice := [n for n, k in Counter(self.names()).items() if k > 1]:
            raise EngineError(f"repeated column names: {', '.join(twice)}")
        keys = sum(c.primary for c in self.columns)
        if keys != 1:
            raise EngineError("a table needs a primary key" if not keys else "a table can have only one primary key")
        done = []
        for c in self.columns:
            if c.type is DataType.VARCHAR and (c.length is None or c.length <= 0):
                raise EngineError(f"VARCHAR column '{c.name}' needs a positive length")
            if c.primary and c.index is IndexKind.NONE:
                c = replace(c, index=IndexKind.RTREE if c.type is DataType.POINT else IndexKind.HASH)
            check_index(c.index, c.type)
            if c.index is not IndexKind.NONE and not c.index_name:
                c = replace(c, index_name=f"idx_{c.name}_{c.index}")
            done.append(c)
        return replace(self, name=self.name.lower(), columns=tuple(done))

    def to_json(self) -> dict:
        return {"name": self.name, "columns": [asdict(c) for c in self.columns]}

    @staticmethod
    def from_json(data: dict) -> TableSchema:
        made = [ColumnDef(**(c | {"type": DataType(c["type"]), "index": IndexKind(c["index"])})) for c in data["columns"]]
        return TableSchema(data["name"], tuple(made))


class SchemaBuilder:
    """Fluent construction: SchemaBuilder("t").column("id", DataType.INT, primary=True).build()."""

    def __init__(self, name: str):
        self._name, self._columns = name, []

    def column(self, name: str, type: DataType, **more) -> SchemaBuilder:
        self._columns.append(ColumnDef(name, type, **more))
        return self

    def build(self) -> TableSchema:
        return TableSchema(self._name, tuple(self._columns)).validated()
