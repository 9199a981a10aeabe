"""Placement of keys on shards by a lookup table that the shards fill in turns.

The table has a prime number of slots. Every shard has its own order of all slots: it starts
at one place and goes on in steps of one size, both from a hash of its name. The shards take
turns, and in its turn a shard claims the first slot of its order that is still free. So all
have nearly the same number of slots, and a shard that comes or goes moves few of the others'
keys. A key is placed by the hash that names its slot.

The size of the table is a parameter and does not grow with the data, so it is broadcast.

Defined cases: a null key is placed like the empty text, a very long one by its hash. Repeated
keys are placed alike. Other columns are kept, but for ``slot`` and ``shard``, which the results
replace. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime, more than a hundred times the number of shards.
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def _hash(name: str, use: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{use}:{name}".encode()).digest()[:8], "big")


def fill_slots(shards: Mapping[str, int], slots: int = SLOTS) -> list[str]:
    """The shard of every slot; ``shards`` gives the slots each one claims per turn."""
    if not _is_prime(slots):
        raise ValueError(f"{slots} is not a prime number")
    if not shards or min(shards.values()) < 1:
        raise ValueError("there must be shards, each with at least one slot per turn")
    names = sorted(shards)
    place = {name: _hash(name, "start") % slots for name in names}
    step = {name: _hash(name, "step") % (slots - 1) + 1 for name in names}
    owner: list[str | None] = [None] * slots
    free = slots
    while free:
        for name in names:
            for _ in range(min(shards[name], free)):
                while owner[place[name]] is not None:
                    place[name] = (place[name] + step[name]) % slots
                owner[place[name]] = name
                free -= 1
    return owner


def place_on_shards(
    df: DataFrame, key: str, shards: Mapping[str, int], slots: int = SLOTS
) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row."""
    owner = fill_slots(shards, slots)
    table = df.sparkSession.createDataFrame(pa.table({
        "slot": pa.array(range(slots), pa.int32()), "shard": pa.array(owner)}))
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    slot = F.pmod(F.xxhash64(text), F.lit(slots)).cast("int")
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    return df.select(*kept, slot.alias("slot")).join(F.broadcast(table), "slot").select(
        *kept, "slot", "shard")
