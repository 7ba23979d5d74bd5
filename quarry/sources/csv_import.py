"""CSV files into declared tables, as one bulk append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import EngineError
from quarry.functions.coerce import from_text
from quarry.schema import ROW_ID, TableSchema


def read_csv(spark: SparkSession, path: str, schema: TableSchema, multiline: bool = False) -> DataFrame:
    """The file's rows as declared columns. The header names every column, in any order; blank rows are skipped.

    If a cell does not fit its column, nothing is returned and the error names the first such row (the header is row 1,
    blank lines are not counted) and column. multiline allows line breaks in quoted cells, at the price of split reads.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multiline).option("enforceSchema", False).csv(path)
    header = [c.strip() for c in raw.columns]
    if unknown := [c for c in header if schema.column(c) is None]:
        raise EngineError(f"column '{unknown[0]}' doesn't exist in table '{schema.name}'")
    if sorted(header) != sorted(schema.names()):
        raise EngineError("the file's columns don't match the table's columns")
    raw = raw.toDF(*header)
    some = F.lit(False)
    for c in header:
        some = some | (F.length(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))) > 0)
    raw = raw.where(some)
    parts = {c.name: from_text(F.col(f"`{c.name}`"), c) for c in schema.columns}
    wrong = F.concat_ws(", ", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, (_, ok) in parts.items()])
    bad = raw.withColumn(ROW_ID, F.monotonically_increasing_id()).withColumn("_wrong", wrong)
    first = bad.where("_wrong <> ''").agg(F.min(F.struct(ROW_ID, "_wrong")).alias("first")).first()["first"]
    if first is not None:
        number = bad.where(F.col(ROW_ID) <= first[ROW_ID]).count() + 1
        raise EngineError(f"row {number}: a value does not fit its column ({first['_wrong']})")
    return raw.select(*[value.alias(n) for n, (value, _) in parts.items()])
