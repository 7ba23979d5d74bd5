"""Sharding by a permutation-filled lookup table (native).

Every shard has a preference order over the slots of a table of prime size: slot ``(offset + j * skip) mod size``.
Shards take turns; each claims the first slot of its order that is still free, until the table is full. A document is
placed by hashing its key to a slot and reading the slot's shard. When a shard is added or removed, few slots change.

The table has ``size`` rows whatever the input, so its broadcast is bounded by that parameter; the placement is one
broadcast hash join on the slot, without a shuffle of documents.

Defined results: a null id is placed by its text; a null id with a null text by the empty key, prefixed so that they
never clash with an id. Repeated ids go to the same shard. A very long text is only read for its hash. An empty table
gives an empty result. Other columns of the input are left alone: the added columns replace none (clashing names raise
``ValueError`` in ``shard_documents``).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a written file.
FILE_BYTES = 256 << 20
#: Production parameters: a prime table size of over 100 slots a shard keeps shares within a percent or two.
SHARDS, TABLE_SIZE = 64, 8191


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The index of the shard that owns each slot. size must be prime, and larger than the number of shards."""
    if not shards or len(shards) > size or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime not below the number of shards, and there must be a shard")
    offset, skip = [], []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        offset.append(int.from_bytes(digest[:8], "big") % size)
        skip.append(int.from_bytes(digest[8:], "big") % (size - 1) + 1)
    owner, step, left = [-1] * size, [0] * len(shards), size
    while left:
        for i in range(len(shards)):
            slot = (offset[i] + step[i] * skip[i]) % size
            while owner[slot] >= 0:
                step[i] += 1
                slot = (offset[i] + step[i] * skip[i]) % size
            owner[slot], step[i], left = i, step[i] + 1, left - 1
            if not left:
                break
    return owner


def table_frame(spark: SparkSession, owner: list[int]) -> DataFrame:
    """(slot, shard), one row a slot, made by Spark from a literal."""
    listed = F.split(F.lit(",".join(map(str, owner))), ",").cast("array<int>")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a string key: 48 bits of its MD5 modulo the table size."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long"), F.lit(size)).cast("int")


def placement_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("t:"), F.coalesce(F.col(text), F.lit(""))))


def shard_documents(docs: DataFrame, shards: int = SHARDS, size: int = TABLE_SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the columns slot and shard."""
    if clash := {"slot", "shard"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    owner = lookup_table([f"shard-{i:05d}" for i in range(shards)], size)
    table = F.broadcast(table_frame(docs.sparkSession, owner))  # size rows, a parameter
    return docs.withColumn("slot", slot_of(placement_key(doc_id, text), size)).join(table, "slot").select(*[docs[c] for c in docs.columns], "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, size: int = TABLE_SIZE, file_bytes: int = FILE_BYTES) -> None:
    """Write docs below path as shard=N folders, in files of about so many bytes of text.

    A shard's rows are spread over as many tasks as its bytes need, by row, so a repeated id or text meets in none.
    """
    placed = shard_documents(docs, shards, size).drop("slot")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // (shards * file_bytes)))
    at = "at" + "_" * max(map(len, docs.columns))  # a name that no column has
    placed = placed.withColumn(at, F.monotonically_increasing_id())
    spread = F.pmod(F.xxhash64(placement_key(), F.col(at)), F.lit(files))
    placed.repartition(shards * files, "shard", spread).drop(at).write.partitionBy("shard").parquet(path)
