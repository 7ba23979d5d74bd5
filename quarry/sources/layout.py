"""Index kinds as file layouts. They change what a scan can skip, never what it returns.

BTREE, AVL, ISAM and BRIN cluster the table by ranges of the column, so that the least and greatest value of every
Parquet row group are tight; RTREE clusters by a Z-order key of the point. A table has one clustering: that of the
first such index. HASH adds a bloom filter on its column to every file, for equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from quarry.functions.spatial import z_order
from quarry.schema import ROW_ID, ColumnDef, IndexKind, TableSchema

CLUSTERING = (IndexKind.BTREE, IndexKind.AVL, IndexKind.ISAM, IndexKind.BRIN, IndexKind.RTREE)


def clustering_column(schema: TableSchema) -> ColumnDef | None:
    return next((c for c in schema.columns if c.index in CLUSTERING), None)


def arranged(df: DataFrame, schema: TableSchema) -> DataFrame:
    """df dealt and sorted as the table's clustering asks for."""
    c = clustering_column(schema)
    if c is None:
        return df
    column = F.col(f"`{c.name}`")
    if c.index is not IndexKind.RTREE:
        return df.repartitionByRange(column, ROW_ID).sortWithinPartitions(column, ROW_ID)
    x, y = column["x"], column["y"]
    box = df.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    if box[0] is None:
        return df
    return df.withColumn("_z", z_order(column, (box[0], box[1]), (box[2], box[3]))).repartitionByRange("_z", ROW_ID).sortWithinPartitions("_z", ROW_ID).drop("_z")


def writer(df: DataFrame, schema: TableSchema) -> DataFrameWriter:
    out = df.write
    for c in schema.columns:
        if c.index is IndexKind.HASH:
            out = out.option(f"parquet.bloom.filter.enabled#{c.name}", "true")
    return out
