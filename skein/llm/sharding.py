"""Sharding by a permutation-filled lookup table: every shard walks its own permutation of a prime-sized table's slots and the shards take
turns claiming their next free slot, so each holds an equal share (or one by weight) and few slots move when a shard comes or goes."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import unused

#: Default table size: a prime, over a hundred times the default number of shards.
SLOTS = 65_537


def _hash(text: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{text}".encode()).digest()[:8], "big")


def lookup_table(shards: dict[str, int], slots: int = SLOTS) -> list[str]:
    """Shard of each slot. shards: name -> weight, the claims it makes in a turn (0: none). slots must be a prime no smaller than the
    number of shards. The result depends on names and weights only, not on their order."""
    if slots < 2 or any(slots % i == 0 for i in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime")
    names = sorted(name for name, weight in shards.items() if weight > 0)
    if not names or len(names) > slots:
        raise ValueError("there must be between 1 and slots shards with a weight over 0")
    start = {name: _hash(name, "offset") % slots for name in names}
    step = {name: _hash(name, "skip") % (slots - 1) + 1 for name in names}
    table: list[str | None] = [None] * slots
    free = slots
    while True:
        for name in names:
            for _ in range(shards[name]):
                while table[start[name]] is not None:
                    start[name] = (start[name] + step[name]) % slots
                table[start[name]] = name
                free -= 1
                if not free:
                    return table  # type: ignore[return-value]


def place(rows: DataFrame, shards: dict[str, int], key: str = "doc_id", slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """rows with slot (long) and shard (string) columns, replacing columns of these names. Equal keys go to one shard; a null key counts as
    the text "null". The table has `slots` rows whatever the data, so its broadcast is bounded; placement shuffles nothing."""
    table = lookup_table(shards, slots)
    spark = rows.sparkSession
    own_slot, own_shard = unused(rows, "skein_slot", "skein_shard")
    lookup = spark.createDataFrame([(i, x) for i, x in enumerate(table)], f"`{own_slot}` long, `{own_shard}` string")
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")))
    at = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % slots
    kept = [c for c in rows.columns if c not in (slot, shard)]
    joined = rows.withColumn(own_slot, at).join(F.broadcast(lookup), own_slot, "left")
    return joined.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{own_slot}`").alias(slot), F.col(f"`{own_shard}`").alias(shard))


def write_shards(placed: DataFrame, path: str, shard: str = "shard", files_per_shard: int = 4) -> None:
    """One folder a shard; a shard's rows are dealt over files_per_shard tasks, so that a large shard isn't one task's work."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in placed.columns]), F.lit(files_per_shard))
    (name,) = unused(placed, "skein_salt")
    placed.withColumn(name, salt).repartition(F.col(shard), F.col(name)).drop(name).write.partitionBy(shard).parquet(path)
