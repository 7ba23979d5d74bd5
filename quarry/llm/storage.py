"""Shared storage for intermediate tables, and the size checks behind broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.files import shared_folder

#: Rows and bytes of a lookup table up to which it is broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files behind materialized tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._quarry_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if it is known (or counted) to have at most limit rows, and these at most BROADCAST_BYTES;
    else leave it to a shuffle join."""
    if (df.count() if rows is None else rows) > limit:
        return df
    fixed = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4}
    wide = [c for c, kind in df.dtypes if kind not in fixed and kind not in ("bigint", "double", "date", "timestamp")]
    if wide:
        found = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*wide))))).first()[0] or 0
        if found > BROADCAST_BYTES:
            return df
    return F.broadcast(df)


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows, so that very long texts do not add up in a Python worker. The setting stays in the
    session, as lazy results read it when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
