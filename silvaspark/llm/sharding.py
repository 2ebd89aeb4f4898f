"""Operator 5: placement of documents on shards by a permutation-filled lookup table, with DataFrame functions only.

Each shard has a permutation of the slots of a prime-sized table: it starts at offset and goes on by skip. In turns the shards claim their
next free slot until the table is full. A document's slot is a hash of its id modulo the table's size, and the table, of fixed size,
is broadcast: placement costs one hash lookup. When a shard goes, few documents of other shards move.

Defined cases: a null id has the slot of the text "null"; equal ids always meet on one shard; an empty table gives an empty
result; texts aren't looked at; further columns are kept, and shard replaces a column of that name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE, SHARDS = 16_381, 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each of size slots the index of its shard."""
    if not shards or len(set(shards)) != len(shards) or not _is_prime(size) or len(shards) > size:
        raise ValueError("distinct shard names and a prime number of slots, no less than shards, are needed")
    digests = [hashlib.md5(s.encode()).hexdigest() for s in shards]
    offset, skip = [int(d[:15], 16) % size for d in digests], [int(d[15:30], 16) % (size - 1) + 1 for d in digests]
    turn, slots, filled = [0] * len(shards), [-1] * size, 0
    while True:
        for i in range(len(shards)):
            while slots[at := (offset[i] + turn[i] * skip[i]) % size] >= 0:
                turn[i] += 1
            slots[at], filled = i, filled + 1
            if filled == size:
                return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(size))


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, *, key: str = "doc_id", table_size: int = TABLE_SIZE) -> DataFrame:
    """docs with shard (int)."""
    slots = lookup_table([f"shard-{i}" for i in range(n_shards)], table_size)
    keep = [c for c in docs.columns if c != "shard"]
    table = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, slots))), ",")).alias("slot", "of"))
    table = F.broadcast(table.select(F.col("slot").cast("bigint").alias("slot"), F.col("of").cast("int").alias("of")))
    # the row is one value, so that its names meet no others
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), slot_of(F.col(f"`{key}`"), table_size).alias("at"))
    return rows.join(table, F.col("at") == F.col("slot")).select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("of").alias("shard"))


def oracle() -> str:
    slots = lookup_table([f"shard-{i}" for i in range(SHARDS)], TABLE_SIZE)
    return f"""
    WITH m AS (SELECT [{','.join(map(str, slots))}] AS slots)
    SELECT doc_id, slots[(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {TABLE_SIZE}) + 1]::INTEGER AS shard
    FROM documents, m
    """
