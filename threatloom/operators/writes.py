"""Graph writes and their dedup to one row per node key and per (src, dst).

Every write carries ``ord``, a ``long`` built from the phase, the number of the report or
alert and the place of the statement in the write sequence. "First write" is ``min(ord)``,
"last write" is ``max(ord)``, and the kind is read back from the low bits.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.vocab import NODE_SEQUENCE, WRITE_SEQUENCE

PLACES = 128
PHASE = 1 << 62
# Stands for a missing ``ord``, below all of them, and the room that a list position takes beside it.
NO_ORD = Decimal(-(1 << 63) - 1)
POS_STEP = Decimal(1 << 32)

_EDGE_PLACE = {name: i for i, name in enumerate(WRITE_SEQUENCE)}
_NODE_PLACE = {name: i for i, name in enumerate(NODE_SEQUENCE)}


def place(name: str) -> int:
    return _EDGE_PLACE[name]


def edge_ord(idx, where, phase=0) -> Column:
    """Write position of an edge; ``where`` is a place name or a column of places."""
    idx = F.col(idx) if isinstance(idx, str) else idx
    where = F.lit(place(where)) if isinstance(where, str) else where
    return F.lit(phase * PHASE).cast("long") + idx.cast("long") * PLACES + where


def edge_kind(ord_col="ord") -> Column:
    names = F.array(*[F.lit(n.split(":")[0]) for n in WRITE_SEQUENCE])
    return F.get(names, F.col(ord_col).bitwiseAND(F.lit(PLACES - 1)).cast("int"))


def node_ord(idx, kind) -> Column:
    idx = F.col(idx) if isinstance(idx, str) else idx
    if isinstance(kind, str):
        where = F.lit(_NODE_PLACE[kind])
    else:
        where = F.create_map(*[F.lit(v) for p in _NODE_PLACE.items() for v in p])[kind]
    return idx.cast("long") * PLACES + where


def node_kind(ord_col) -> Column:
    ord_col = F.col(ord_col) if isinstance(ord_col, str) else ord_col
    names = F.array(*[F.lit(n) for n in NODE_SEQUENCE])
    return F.get(names, ord_col.bitwiseAND(F.lit(PLACES - 1)).cast("int"))


def edge_writes(df: DataFrame, src, dst, idx, where, phase=0) -> DataFrame:
    return df.select(
        (F.col(src) if isinstance(src, str) else src).alias("src"),
        (F.col(dst) if isinstance(dst, str) else dst).alias("dst"),
        edge_ord(idx, where, phase).alias("ord"),
    )


def node_writes(df: DataFrame, key, idx, kind, pos=None) -> DataFrame:
    return df.select(
        (F.col(key) if isinstance(key, str) else key).alias("key"),
        node_ord(idx, kind).alias("ord"),
        (F.lit(0) if pos is None else F.col(pos)).cast("long").alias("pos"),
    )


def dedup_nodes(writes: DataFrame) -> DataFrame:
    """One row per key: a key ever written as report or alert is that, else the first kind wins."""
    owner = F.max(F.when(node_kind("ord").isin("report", "alert"), F.col("ord")))
    grouped = writes.groupBy("key").agg(F.min(_rank("ord", "pos")).alias("rank"), owner.alias("owner"))
    first = grouped.select("key", "owner", *_unranked("rank", "ord", "pos"))
    return first.select("key", node_kind(F.coalesce("owner", "ord")).alias("ntype"), "ord", "pos")


def _rank(ord_col, pos_col) -> Column:
    """Two numbers as one that orders alike, nulls first; ``pos`` is a place in a list, so it fits into 32 bits.

    The least of a struct is found by sorting all rows, the least number in a hash table.
    """
    high = F.coalesce(F.col(ord_col).cast("decimal(20,0)"), F.lit(NO_ORD))
    return high * F.lit(POS_STEP) + F.coalesce(F.col(pos_col) + 1, F.lit(0)).cast("decimal(10,0)")


def _unranked(rank, ord_col, pos_col):
    low = F.pmod(rank, F.lit(POS_STEP))
    high = (F.col(rank) - low) / F.lit(POS_STEP)
    return [
        F.when(F.col(rank) >= F.lit((NO_ORD + 1) * POS_STEP), high).cast("long").alias(ord_col),
        F.when(low > 0, low - 1).cast("long").alias(pos_col),
    ]


def dedup_edges(writes: DataFrame, mode="parity") -> DataFrame:
    """One row per (src, dst) with the kind written last, or with ``multi`` one per kind too."""
    if mode == "multi":
        kinds = writes.select("src", "dst", edge_kind().alias("etype"), "ord")
        return kinds.groupBy("src", "dst", "etype").agg(F.max("ord").alias("ord"))
    last = writes.groupBy("src", "dst").agg(F.max("ord").alias("ord"))
    return last.select("src", "dst", edge_kind().alias("etype"), "ord")
