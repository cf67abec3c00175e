"""Equi-join whose hot keys are cut into blocks on both sides."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one side that one join key may bring to one task before the key is cut up.
BLOCK_ROWS = 8192
# Above this many hot keys their table is joined by shuffle instead of broadcast.
BROADCAST_KEYS = 200_000
# Rows that one task of a shuffle of known size sorts or groups.
TASK_ROWS = 1_000_000


def tasks_for(df: DataFrame, rows: int):
    """Number of tasks for ``rows`` rows at ``TASK_ROWS`` each, or () where Spark's own choice makes as many.

    Adaptive execution joins small partitions until every core has one of up to 64 compressed MB, which may be
    gigabytes in memory; so without a number a task's memory grows with the input.
    """
    n = -(-rows // TASK_ROWS)
    return (n,) if n > df.sparkSession.sparkContext.defaultParallelism else ()


def spread(df: DataFrame, rows: int, *keys) -> DataFrame:
    """``df`` shuffled by ``keys`` into tasks of about ``TASK_ROWS`` rows, ``rows`` being its size or more."""
    return df.repartition(*tasks_for(df, rows), *keys)


def broadcast_if_small(df: DataFrame, rows=BROADCAST_KEYS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_keys(left: DataFrame, right: DataFrame, on, block_rows=BLOCK_ROWS) -> DataFrame:
    """Keys present on both sides with more than ``block_rows`` rows on one, and their block counts."""
    sides = left.select(*on, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*on, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sized = sides.groupBy(*on).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    blocks = lambda c: F.ceil(F.col(c) / F.lit(block_rows)).cast("int")
    return sized.where((F.least("l", "r") > 0) & (F.greatest("l", "r") > block_rows)).select(
        *on, blocks("l").alias("_lb"), blocks("r").alias("_rb")
    )


def blocked_join(left: DataFrame, right: DataFrame, on, left_id, right_id, block_rows=BLOCK_ROWS) -> DataFrame:
    """``left`` inner-joined with ``right`` on ``on``; the result is the plain equi-join's, whole.

    A key with many rows on both sides would make one task write their whole product. Such
    keys are found first (one aggregation). Their left rows get a block by hash of
    ``left_id`` and are copied to every right block, and the other way round, so each task
    joins at most about ``block_rows`` by ``block_rows`` rows of one key. Other keys keep one block.
    """
    on = [on] if isinstance(on, str) else list(on)
    hot = hot_keys(left, right, on, block_rows).persist()
    n_hot = hot.limit(BROADCAST_KEYS + 1).count()
    if n_hot == 0:
        hot.unpersist()
        return left.join(right, on)
    sizes = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
    lb, rb = F.coalesce("_lb", F.lit(1)), F.coalesce("_rb", F.lit(1))
    own = lambda ids, n: F.pmod(F.xxhash64(*ids), n.cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    as_list = lambda ids: [ids] if isinstance(ids, str) else list(ids)
    cut_left = left.join(sizes, on, "left").select(*left.columns, own(as_list(left_id), lb).alias("_lk"), every(rb).alias("_rk"))
    cut_right = right.join(sizes, on, "left").select(*right.columns, own(as_list(right_id), rb).alias("_rk"), every(lb).alias("_lk"))
    return cut_left.join(cut_right, [*on, "_lk", "_rk"]).drop("_lk", "_rk")
