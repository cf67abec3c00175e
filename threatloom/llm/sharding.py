"""Shard placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size. The shards take
turns, each claiming its next free slot, until the table is full, so all have almost equally many
slots, and few slots change when a shard comes or goes. The table has a fixed size, is sent to
all tasks, and places a key with one lookup.

Defined results: equal keys go to one shard (a null key like an empty string); repeated rows stay; an
empty table gives no rows; other columns stay, and columns of the same names are replaced.
"""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Slots: a prime over a hundred times the number of shards keeps their loads within a percent.
TABLE_SLOTS = 65_537


def lookup_table(shards: list, slots=TABLE_SLOTS) -> list:
    """Shard number of each slot."""
    if any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)) or slots < max(2, len(shards)):
        raise ValueError("slots must be a prime that is not smaller than the number of shards")
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards must have distinct names")
    half = lambda name, part: int.from_bytes(hashlib.sha256(str(name).encode()).digest()[8 * part : 8 * part + 8], "big")
    offset = [half(s, 0) % slots for s in shards]
    skip = [half(s, 1) % (slots - 1) + 1 for s in shards]
    turn, table, free = [0] * len(shards), [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while True:
                slot = (offset[i] + turn[i] * skip[i]) % slots
                turn[i] += 1
                if table[slot] < 0:
                    break
            table[slot] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key, slots=TABLE_SLOTS):
    """Slot of a key column: 60 bits of its MD5, the same in any engine."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, shards: list, slots=TABLE_SLOTS) -> DataFrame:
    """(slot, shard): the table as rows."""
    return spark.createDataFrame(list(enumerate(lookup_table(shards, slots))), "slot int, shard int")


def place(df: DataFrame, shards: list, key_col="doc_id", slots=TABLE_SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; the table (``slots`` rows) is broadcast, nothing is shuffled."""
    rest = [c for c in df.columns if c not in ("slot", "shard")]
    placed = df.select(*rest, slot_of(df[key_col], slots).alias("slot"))
    return placed.join(F.broadcast(table_frame(df.sparkSession, shards, slots)), "slot", "left")


def write_shards(df: DataFrame, path: str, shards: list, key_col="doc_id", slots=TABLE_SLOTS, files=4) -> None:
    """Write ``df`` in one folder a shard; each shard's rows go to ``files`` tasks by slot, so a large shard is split."""
    placed = place(df, shards, key_col, slots)
    n = len(shards) * files
    dealt = placed.repartition(n, "shard", F.pmod(F.xxhash64("slot"), F.lit(files)))
    dealt.drop("slot").write.partitionBy("shard").parquet(path)
