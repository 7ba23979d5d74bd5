"""Connected components by alternating large-star and small-star rounds, all in DataFrame operations.

Every round groups by a minimum and joins it back, so a node with very many neighbours is aggregated before the
shuffle and its join can be split; nothing is gathered per node. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.storage import discard, materialize


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least.withColumnRenamed("a", "node"), F.col("a") == F.col("node")).select("b", "m").where("b <> m").toDF("a", "b")
    return joined.union(least.toDF("a", "b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) of 64-bit ids to (node, root): the least id that each linked node reaches. Nodes that are roots are left out.
    The result is a materialized table, to be discarded by the caller."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        after = materialize(_round(edges), "stars")
        discard(edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._quarry_path = edges._quarry_path
    return out


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges: their number, and two folded hashes."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("b", "a"))).first())
