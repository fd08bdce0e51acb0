"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own (offset and skip from a
hash of its name). Shards take turns claiming their next free slot until the table is full, so
shards differ by at most one slot (by their weights, where given), and a shard that is added or
removed moves few other slots. The table goes to all tasks; a row is placed by one hash and one
lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots: a prime, over a hundred for each shard. A table of at most MAX_SLOTS is broadcast.
SLOTS, MAX_SLOTS = 4099, 1_000_003


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS, weights: list[float] | None = None) -> list[int]:
    """The number of the shard that holds each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not _prime(slots) or len(shards) > slots or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    weights = weights or [1.0] * len(shards)
    if len(weights) != len(shards) or min(weights) <= 0:
        raise ValueError("one positive weight for each shard")
    order = []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        order.append([int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1])
    table, free, credit = [-1] * slots, slots, [0.0] * len(shards)
    largest = max(weights)
    while free:
        for i, (at, skip) in enumerate(order):
            credit[i] += weights[i] / largest
            if credit[i] < 1:
                continue
            credit[i] -= 1
            while table[at] >= 0:
                at = (at + skip) % slots
            table[at], order[i][0] = i, (at + skip) % slots
            free -= 1
            if not free:
                break
    return table


def place(docs: DataFrame, shards: list[str], id_col: str = "doc_id", text_col: str | None = "text", slots: int = SLOTS, weights: list[float] | None = None) -> DataFrame:
    """The rows with ``slot`` (long) and ``shard`` (name).

    Rows with the same id share a shard. Rows without an id are dealt by their text (null as
    empty), so that they don't meet in one shard. No shuffle. Columns named ``slot`` or ``shard``
    are replaced; repeated rows stay.
    """
    kept = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    key = F.col(id_col).cast("string")
    if text_col:
        key = F.coalesce(key, F.concat(F.lit("text:"), F.coalesce(F.col(text_col), F.lit(""))))
    slot = F.conv(F.substring(F.sha2(F.coalesce(key, F.lit("")), 256), 1, 15), 16, 10).cast("long") % slots
    rows = [(i, shards[s]) for i, s in enumerate(fill(shards, slots, weights))]
    table = docs.sparkSession.createDataFrame(rows, "slot long, shard string")
    out = docs.select(*kept, slot.alias("slot")).join(F.broadcast(table), "slot", "left")
    return out.select(*kept, "slot", "shard")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Writes placed rows to one folder per shard, a shard's rows in ``files_per_shard`` files."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(files_per_shard))
    placed.withColumn("_salt", salt).repartition("shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)
