"""Placement of rows on shards through a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: a start and
a stride, both from a digest of its name. Shards take turns; on its turn a shard
claims the first slot of its order that is still free. Each shard so gets its share of
the slots to within one, and removing a shard moves few rows besides its own. A row's
slot is a digest of its key modulo the table size, so placement is one look-up in a
broadcast table, whatever the number of rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The broadcast table has one row per slot, so this bounds its size (about 16 MB).
MAX_SLOTS = 1_000_003
# Slots per shard that keep shares even to about one per cent.
SLOTS_PER_SHARD = 100


def _digest(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def table_size(shards: int) -> int:
    """The smallest prime with at least ``SLOTS_PER_SHARD`` slots for each shard."""
    size = max(2, shards * SLOTS_PER_SHARD)
    while not _is_prime(size):
        size += 1
    return size


def fill_slots(shards: list[str], size: int | None = None) -> list[int]:
    """The shard number of each slot; depends on names and table size alone.

    The work is in proportion to the table, which ``MAX_SLOTS`` bounds. Shard names
    must be distinct and not fewer than one; ``size`` must be a prime not below their
    number.
    """
    size = size or table_size(len(shards))
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not _is_prime(size) or not len(shards) <= size <= MAX_SLOTS:
        raise ValueError(f"the table size must be a prime from {len(shards)} to {MAX_SLOTS}")
    at = [_digest(name, "start") % size for name in shards]
    stride = [_digest(name, "stride") % (size - 1) + 1 for name in shards]
    slots = [-1] * size
    for turn in range(size):
        shard = turn % len(shards)
        while slots[at[shard]] >= 0:
            at[shard] = (at[shard] + stride[shard]) % size
        slots[at[shard]] = shard
    return slots


def slot_of(key: str | Column, size: int) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo the size."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size))


def slot_table(spark: SparkSession, shards: list[str], size: int | None = None) -> DataFrame:
    """The lookup table as rows (slot, shard): a range and one folded array literal."""
    slots = fill_slots(shards, size)
    names = F.split(F.lit("\n".join(shards)), "\n")
    owner = F.element_at(F.split(F.lit(",".join(map(str, slots))), ","), F.col("id").cast("int") + 1)
    return spark.range(len(slots)).select(
        F.col("id").alias("slot"),
        F.element_at(names, owner.cast("int") + 1).alias("shard"),
    )


def place(df: DataFrame, key: str, shards: list[str], size: int | None = None) -> DataFrame:
    """Each row's key, slot and shard; nothing but the table is moved.

    Rows with an equal key share a shard. A null key counts as the empty text, repeated
    rows are all returned, other columns are not carried (so their names cannot clash),
    and an empty table gives no row.
    """
    size = size or table_size(len(shards))
    table = slot_table(df.sparkSession, shards, size)
    keyed = df.select(F.col(key)).withColumn("slot", slot_of(key, size))
    return keyed.join(F.broadcast(table), "slot").select(key, "slot", "shard")


def write_shards(
    df: DataFrame, key: str, shards: list[str], path: str, splits: int = 1, size: int | None = None
) -> None:
    """Write whole rows below ``path``, a folder ``shard=...`` for each shard.

    Rows are moved once, by shard and one of ``splits`` parts, so that a shard may be
    written by many tasks. ``df`` must have no column named ``shard``.
    """
    size = size or table_size(len(shards))
    part = F.pmod(F.xxhash64(F.col(key), F.lit("part")), F.lit(splits))
    table = slot_table(df.sparkSession, shards, size).withColumnRenamed("slot", "__slot")
    placed = df.withColumn("__slot", slot_of(key, size)).join(F.broadcast(table), "__slot")
    placed = placed.drop("__slot").repartition(len(shards) * splits, F.col("shard"), part)
    placed.write.partitionBy("shard").parquet(path)
