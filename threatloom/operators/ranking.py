"""Dense row numbers over large groups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from threatloom.operators.joins import null_safe_join
from threatloom.operators.pairs import broadcast_if_small, tasks_for
from threatloom.session import checkpointed


def dense_index(df: DataFrame, order, partition=(), name="idx", rows=0) -> DataFrame:
    """Add a 0-based row number per ``partition`` in ``order`` without one task per partition key.

    The rows are range-partitioned by (partition, order) and written once, so even a key with
    most of the rows is spread over all tasks. Each written range knows its row positions;
    adding the number of rows in earlier ranges (one small row per range and key) makes the
    numbers dense. ``order`` must be a total order for the result to be repeatable. A null key is a
    group like any other. ``rows``, if the caller knows about how many there are, bounds the rows of a range.
    """
    keys, order = list(partition), list(order)
    sorted_rows = df.repartitionByRange(*tasks_for(df, rows), *keys, *order).sortWithinPartitions(*keys, *order)
    placed = checkpointed(sorted_rows.withColumn("_at", F.monotonically_increasing_id()))
    range_no = F.shiftright("_at", 33)
    ranges = placed.groupBy(*keys, range_no.alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    ranges = ranges.select(*keys, "_range", shift.alias("_shift"))
    joined = null_safe_join(placed.withColumn("_range", range_no), broadcast_if_small(checkpointed(ranges)), [*keys, "_range"])
    return joined.select(*df.columns, (F.col("_at") + F.col("_shift")).cast("long").alias(name))


def take_per_group(df: DataFrame, order, counts: DataFrame, partition=(), size="size") -> DataFrame:
    """The first ``size`` rows of every group, where ``counts`` gives a size per group key."""
    ranked = dense_index(df, order, partition, "_rank")
    if partition:
        sized = null_safe_join(ranked, counts.select(*partition, size), list(partition))
    else:
        sized = ranked.withColumn(size, counts.select(size).scalar())
    return sized.where(F.col("_rank") < F.col(size)).select(*df.columns)
