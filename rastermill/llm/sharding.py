"""Shard placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size, given by an
offset and a step. The shards take turns; in its turn a shard claims the first slot of its order
that is still free (a shard of weight w takes w turns a round). Adding or removing a shard moves few slots.
A row goes to the shard of slot `hash(key) mod size`: one broadcast join on the slot, no shuffle.

The table has `size` rows whatever the number of documents; `size` is checked against MAX_SIZE
before it is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest table that is broadcast (16 bytes a slot).
MAX_SIZE = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def hash60(key: Column) -> Column:
    """The first 15 hex digits of the key's MD5 as a number."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def preferences(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    """Offset and step of each shard's order: slot(j) = (offset + j * step) mod size."""
    names = spark.range(len(shards)).select(
        F.col("id").cast("int").alias("shard_no"),
        F.element_at(F.array(*map(F.lit, shards)), (F.col("id") + 1).cast("int")).alias("shard"),
    )
    return names.select(
        "shard_no",
        "shard",
        (hash60(F.concat(F.lit("offset:"), "shard")) % size).alias("offset"),
        (hash60(F.concat(F.lit("step:"), "shard")) % (size - 1) + 1).alias("step"),
    )


def fill(orders: Sequence[tuple[int, int]], turns: Sequence[int], size: int) -> list[int]:
    """The shard number of every slot: shards claim slots in turn, each the next free one of its order."""
    owner, free, at = [-1] * size, size, [offset for offset, _ in orders]
    while free:
        for shard, (_, step) in enumerate(orders):
            for _ in range(turns[shard]):
                while owner[at[shard]] >= 0:
                    at[shard] = (at[shard] + step) % size
                owner[at[shard]] = shard
                free -= 1
                if not free:
                    return owner
    return owner


def lookup_table(spark: SparkSession, shards: Sequence[str], size: int, weights: Mapping[str, int] | None = None) -> DataFrame:
    """slot, shard_no, shard: one row for each slot."""
    shards = list(shards)
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not is_prime(size) or not len(shards) < size <= MAX_SIZE:
        raise ValueError(f"size must be a prime above the number of shards and at most {MAX_SIZE}")
    turns = [int((weights or {}).get(s, 1)) for s in shards]
    if min(turns) < 1:
        raise ValueError("weights must be 1 or more")
    pref = preferences(spark, shards, size)
    # One row per shard: as many as the caller named.
    orders = [(r.offset, r.step) for r in pref.orderBy("shard_no").collect()]
    owners = F.split(F.lit(",".join(map(str, fill(orders, turns, size)))), ",")
    slots = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    return slots.select(F.col("slot").cast("long").alias("slot"), F.col("owner").cast("int").alias("shard_no")).join(
        F.broadcast(pref.select("shard_no", "shard")), "shard_no"
    )


def place(rows: DataFrame, table: DataFrame, key: str, size: int) -> DataFrame:
    """Adds slot, shard_no and shard to every row; columns of those names are replaced.

    A null key counts as the empty text; equal keys share a slot, so a hot key stays on one shard:
    give a salted key to spread it. An empty table stays empty.
    """
    slot = hash60(F.coalesce(F.col(key).cast("string"), F.lit(""))) % size
    return rows.drop("shard_no", "shard").withColumn("slot", slot).join(F.broadcast(table), "slot", "left")
